"""Substring dedup against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from eventloom.llm import suffix_dedup
from eventloom.llm.suffix_dedup import LENGTH, batch_anchors, dedup_substrings, merge_runs, mismatch
from eventloom.session import shared_folder


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + LENGTH] for d in data for i in range(len(d) - LENGTH + 1))
    rows = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - LENGTH + 1):
            if seen[d[i:i + LENGTH]] > 1:
                gone[i:i + LENGTH] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        rows.append((len(d), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return rows


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(60) for _ in range(3)]
    made = [None, "", "x", "a" * 900, "ab" * 300, "a" * 199, prose(20)]
    for _ in range(40):
        made.append(prose(rng.randint(0, 80)) + rng.choice(passages)[rng.randint(0, 40):] + prose(rng.randint(0, 80)))
    copy = list(made[20])
    copy[len(copy) // 2] = "#"
    made += [made[10], made[10], "".join(copy), made[12][:250] + made[12][251:], passages[0] + passages[0], prose(3000)]
    return made


@pytest.mark.parametrize("seed, spread_from", [(1, 20_000), (2, 3)])
def test_against_all_windows(spark, seed, spread_from):
    made = texts(seed)
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3, "doc_id")
    folder = shared_folder(spark) + f"/suffix-{seed}-{spread_from}"
    docs.write.mode("overwrite").parquet(folder)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())
           for r in dedup_substrings(spark.read.parquet(folder), spread_from=spread_from).collect()}
    assert [got[i] for i in range(len(made))] == brute(made)


def test_long_text_in_blocks(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 1000)
    rng = random.Random(3)
    text = bytes(rng.choice(b"abcdefgh ") for _ in range(5000))
    found = batch_anchors(np.array([7]), [text, b"short"])
    starts = [p - d for p, a, b in zip(found["spot"] >> 16, found["spot"] >> 8 & 255, found["spot"] & 255) for d in range(b, a + 1)]
    assert sorted(starts) == list(range(len(text) - LENGTH + 1))
    assert set(found["_row"]) == {7}


@pytest.mark.parametrize("runs", [1, 2, 3, 7])
def test_merge_is_sorted_and_knows_prefixes(runs):
    rng = random.Random(runs)
    made = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 30))) for _ in range(runs)]
    coded = [(run, [0, *(mismatch(a, b, 0) for a, b in zip(run, run[1:]))]) for run in made]
    merged = list(merge_runs(coded))
    strings = [made[r][i] for r, i, _ in merged]
    assert strings == sorted(s for run in made for s in run)
    assert [p for _, _, p in merged][1:] == [mismatch(a, b, 0) for a, b in zip(strings, strings[1:])]


def test_empty(spark):
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string, kept string")).collect() == []
