"""Periodic runs against a scan of all lags."""

import hashlib
import random
import re
import zlib

import numpy as np

from eventloom.llm import periodic_runs, queries

DOCS = "doc_id long, text string, runs string, n_words int"


def all_runs(words):
    """Every lag, smallest first; a stretch that a smaller lag has is not taken again."""
    found = {}
    for period in range(1, len(words) // 4 + 1):
        at = 0
        while at < len(words) - period:
            end = at
            while end < len(words) - period and words[end] == words[end + period]:
                end += 1
            length = end - at + period
            if end > at and length >= max(6, 4 * period):
                found.setdefault((at, length), period)
            at = max(end, at + 1)
    return sorted((start, length, period) for (start, length), period in found.items())


def collapsed(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(rng, n, size):
    words = [f"w{rng.randrange(size)}" for _ in range(n)]
    if n and rng.random() < .6:
        at = rng.randrange(n)
        period = 1 + (n - at) // (3 + rng.randrange(8))
        words = [words[i] if i < at else words[at + (i - at) % period] for i in range(n)]
    return words


def test_batches_against_all_lags():
    rng = random.Random(5)
    for _ in range(400):
        texts = [[w.encode() for w in some_words(rng, rng.choice([0, 1, 5, 6, 7, 8, 20, 60, 150]), rng.choice([1, 2, 3, 5, 30]))]
                 for _ in range(rng.randint(0, 5))]
        runs, borders = periodic_runs.runs_of_texts(texts)
        want = [(start + int(at), length, period) for words, at in zip(texts, borders) for start, length, period in all_runs(words)]
        assert list(zip(*(part.tolist() for part in runs))) == sorted(want)


def test_splitting_leaves_only_frequent_words():
    words = np.array([0, 1, 0, 1, 0, 1, 0, 1, 9, 2, 2, 2, 2, 2, 3, 2, 2, 2, 2, 2, 2, 4, 3, 3, 3])
    starts, ends = periodic_runs.split_rare(words, np.array([0]), np.array([len(words)]))
    assert list(zip(starts, ends)) == [(0, 8), (15, 21)]
    # Many rounds, each of which cuts one word off; the result does not depend on where splitting stops.
    peeled = [w for n in range(200) for w in (n, n + 1, n + 1, n + 2, n)] + [7] * 9
    runs, _ = periodic_runs.runs_of_texts([[b"%d" % w for w in peeled]])
    assert list(zip(*(p.tolist() for p in runs))) == all_runs(peeled)


def test_rows(spark):
    texts = [None, "", " \n\t", "a", "a a a a a", "a\ta\na  a a a", "x " * 50_000, "é b " * 4 + "é", "a b c d " * 2, "a b c " * 4]
    rows = [(None if n == 3 else n % 8, t, "clash", 1) for n, t in enumerate([*texts, texts[5]])]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = periodic_runs.find_runs(docs, ["doc_id", "runs"]).collect()
    want = []
    for key, text, *_ in rows:
        words = (text or "").split()
        runs = all_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
        want.append((key, len(words), runs, collapsed(words, runs)))
    assert sorted(map(str, ((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got))) == sorted(map(str, want))
    assert periodic_runs.find_runs(spark.createDataFrame([], DOCS), ["doc_id"]).count() == 0


def test_registered_query(spark, tmp_path):
    rng = random.Random(8)
    rows = [(n, " ".join(some_words(rng, rng.randrange(90), 25))) for n in range(150)] + [(7, "a b"), (8, None), (None, "a " * 7)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = all_runs(words)
        start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{l},{q}\n" for s, l, q in runs)
        want.append((doc_id, len(runs), start, length, period, 1000 * length // period if runs else None,
                     hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest()))
    got = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert sum(r[1] > 0 for r in want) > 10
    assert dict(got.dtypes)["exponent_milli"] == "bigint" and dict(got.dtypes)["start"] == "bigint"
