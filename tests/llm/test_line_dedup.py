"""Line dedup against a comparison of all pairs."""

import random
import re
from itertools import combinations

import pytest
import xxhash

from eventloom.llm import line_dedup
from eventloom.llm.line_dedup import dedup_lines, judge_lines, lines_of, measured_lines, numbered, similar_pairs
from eventloom.session import shared_folder


def words_of(line):
    return re.findall(r"[^\x20\x09-\x0D]+", line.lower())


def features(line):
    text = " ".join(words_of(line))
    words = text.split(" ")
    return list(dict.fromkeys(words)) if len(words) >= 4 else [text[i:i + 2] for i in range(len(text))]


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def blocks(line):
    """(size, block) of the five blocks."""
    groups = [[] for _ in range(5)]
    for word in features(line):
        groups[signed(xxhash.xxh64_intdigest(word[:1].encode(), seed=42)) % 5].append(xxhash.xxh64_intdigest(word.encode(), seed=42))
    places = [s + 12 * k for s in range(3) for k in range(5)]
    return [(len(g), sum(1 << i for i, at in enumerate(places) if sum(h >> at & 1 for h in g) * 2 > len(g))) for g in groups]


def joined(a, b):
    """True if three blocks are equal and hold words enough in both lines."""
    def enough(line, key):
        held = sum(line[i][0] for i in key)
        return held >= 2 and 4 * held >= sum(n for n, _ in line)
    return any(all(a[i][1] == b[i][1] for i in key) and enough(a, key) and enough(b, key) for key in combinations(range(5), 3))


def edits(a, b, most):
    """Edit distance, or more than ``most``: only cells that near the diagonal are filled."""
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        now = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            now[j] = i if not j else min(row.get(j, most) + 1, now.get(j - 1, most) + 1, row.get(j - 1, most + 1) + (x != b[j - 1]))
        row = now
    return row.get(len(b), most + 1)


def similar_texts(a, b):
    allowed = int(0.1 * max(len(a), len(b)) + 1e-9)
    return abs(len(a) - len(b)) <= allowed and edits(a, b, allowed) <= allowed


def brute(lines):
    """Group number of each line: equal lines, and similar lines that share three blocks, followed through."""
    texts = [" ".join(words_of(line)) for line in lines]
    prints = [blocks(line) for line in lines]
    group = list(range(len(lines)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            if texts[i] == texts[j] or joined(prints[i], prints[j]) and similar_texts(texts[i], texts[j]):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    return [root(i) for i in range(len(lines))]


def stored(spark, rows, name, schema="doc_id long, text string"):
    folder = shared_folder(spark) + f"/{name}"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(n)] for n in (1, 3, 8, 20, 40, 90)]
    lines = []
    for _ in range(150):
        words = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 5))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        lines.append(" ".join(words))
    lines += ["", "  ", "\t", "A  b\tc", "a B c ", "É é", "é é", "x " * 600, " ".join(f"w{i}" for i in range(1300))]
    rng.shuffle(lines)
    texts = ["\n".join(lines[i:i + 7]) for i in range(0, len(lines), 7)] + [None, "", "\n\n", lines[3], lines[3]]
    return list(enumerate(texts)) + [(None, lines[5]), (1, texts[1])]


@pytest.mark.parametrize("narrow", [2047, 40])
def test_prints(spark, documents, narrow):
    docs = numbered(stored(spark, documents, f"lines-a{narrow}"))
    lines = lines_of(docs)
    got = {r.at: (r.fp, r.rest) for r in measured_lines(docs, narrow).collect()}
    text = {r._at: r.text for r in lines.collect()}
    assert set(got) == set(text)
    for at, (fp, rest) in got.items():
        found = blocks(text[at])
        sizes = [n for n, _ in found]
        held = [sum(sizes[i] for i in key) for key in combinations(range(5), 3)]
        keys = [n >= 2 and 4 * n >= sum(sizes) for n in held]
        assert [fp >> 15 * j & 0x7FFF for j in range(4)] + [rest & 0x7FFF] == [b for _, b in found]
        assert [bool(rest >> 15 + n & 1) for n in range(10)] == keys and rest >> 25 == len(text[at])
    assert all(t == " ".join(words_of(t)) for t in text.values())


def test_groups(spark, documents):
    got = sorted(judge_lines(numbered(stored(spark, documents, "lines-b"))).collect(), key=lambda r: (r._row, r._line))
    lines = [line for _, text in documents for line in (text or "").split("\n") if words_of(line)]
    assert len(got) == len(lines)
    want = brute(lines)
    first = {}
    for i, row in enumerate(got):
        first.setdefault(row.group, i)
    assert [first[r.group] for r in got] == want
    assert [r.kept for r in got] == [want[i] == i for i in range(len(lines))]


def test_texts(spark, documents):
    docs = [(i, t, "en", len(t or "")) for i, t in documents]
    got = dedup_lines(stored(spark, docs, "lines-c", "doc_id long, text string, dropped string, _line long")).collect()
    assert len(got) == len(docs)
    kept = sorted(line for r in got for line in (r.text or "").split("\n") if words_of(line))
    lines = [line for _, text in documents for line in (text or "").split("\n") if words_of(line)]
    assert kept == sorted(line for line, group, i in zip(lines, brute(lines), range(len(lines))) if group == i)
    assert sum(r.text is None for r in got) == 1


def test_empty(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def typo(rng, word):
    """The word with one character replaced, left out or added."""
    at, letter = rng.randrange(len(word)), rng.choice("abcdefghijklmnopqrstuvwxyz")
    return rng.choice((word[:at] + letter + word[at + 1:], word[:at] + letter + word[at:], word[:at] + word[at + 1:]))


@pytest.mark.parametrize("words, typos, least", [(4, 1, 0.7), (6, 1, 0.9), (8, 2, 0.5), (20, 1, 0.9), (20, 2, 0.7), (50, 1, 0.99), (50, 3, 0.4),
                                                 (200, 3, 0.4), (1000, 2, 0.7)])
def test_recall_of_typos(spark, words, typos, least):
    """Pairs that differ by characters in some words, whatever their blocks."""
    rng = random.Random(words * 10 + typos)
    lines = []
    for _ in range(300):
        line = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9))) for _ in range(words)]
        other = list(line)
        for i in rng.sample(range(words), typos):
            other[i] = typo(rng, other[i])
        lines += [" ".join(line), " ".join(other)]
    rows = judge_lines(numbered(stored(spark, list(enumerate(lines)), f"lines-t{words}-{typos}"))).collect()
    group = {r._id: r.group for r in rows}
    assert len({group[i] for i in range(0, 600, 2)}) == 300
    found = sum(group[i] == group[i + 1] for i in range(0, 600, 2)) / 300
    print("recall", words, typos, found)
    assert found >= least


@pytest.mark.xfail(reason="open: a changed character of a line of few words can change three blocks, and keys bear two")
def test_typo_in_a_single_word(spark):
    rows = [(0, "internationalisation"), (1, "internationalisatiom")]
    got = {r._id: r.group for r in judge_lines(numbered(stored(spark, rows, "lines-few"))).collect()}
    assert got[0] == got[1]


def test_lines_without_spaces(spark):
    """Lines of few words are taken by pairs of characters."""
    rows = [(2, "a"), (3, "b"), (4, "\u8fd9" * 3000 + "\u662f\u4e00\u884c"), (5, "\u8fd9" * 3000 + "\u662f\u4e8c\u884c"), (6, "A")]
    got = {r._id: r.group for r in judge_lines(numbered(stored(spark, rows, "lines-few2"))).collect()}
    assert got[4] == got[5] and got[2] == got[6]
    assert len(set(got.values())) == 3


def test_hot_key_of_lines_that_are_not_similar(spark):
    """Lines that share a passage, and so a key, but are not similar stay; similar ones among them are found."""
    rng = random.Random(3)
    shared = "please read the notes of the seller before you place an order"
    rows = [(i, shared + " " + " ".join(f"zz{rng.randrange(10**9)}" for _ in range(12))) for i in range(200)]
    rows += [(200 + i, rows[i][1] + "s") for i in range(0, 200, 2)]
    got = {r._id: r.group for r in judge_lines(numbered(stored(spark, rows, "lines-hot"))).collect()}
    assert all(got[200 + i] == got[i] for i in range(0, 200, 2)) and len(set(got.values())) == 200


def test_pairs_by_words(spark):
    """Bounds by words and common ends change no verdict."""
    rng = random.Random(8)
    pairs = [("", ""), ("a", "a"), ("a b", "a"), ("a a a a a a a a a a a", "a a a a a a a a a a"), ("x" * 40, "x" * 39), ("a b c d", "b c d a")]
    for _ in range(600):
        line = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 30))]
        other = list(line)
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            at = rng.randrange(len(other))
            other[at:at + 1] = rng.choice(([typo(rng, other[at]) or "b"], [other[at]] * 2, [other[at] + "c"], [], [other[at], "ab"])) or other[at + 1:at + 2] or ["a"]
        pairs.append((" ".join(line), " ".join(other)))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, one string, two string")
    got = {r.i for r in similar_pairs(df).collect()}
    want = {i for i, (a, b) in enumerate(pairs) if similar_texts(a, b)}
    assert got == want and 100 < len(want) < 500


def test_votes_are_compiled_and_read_once(spark, monkeypatch):
    docs = numbered(stored(spark, [(0, "one two three four five"), (1, "one two three four fife"), (2, "x")], "lines-code"))
    cut, kept = line_dedup.cut_lineage, []
    monkeypatch.setattr(line_dedup, "cut_lineage", lambda df: (kept.append(df), cut(df))[1])
    monkeypatch.setattr(line_dedup, "_wide_votes", lambda rows: pytest.fail("no line has so many words"))
    assert len(judge_lines(docs).collect()) == 3
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    code = measured_lines(docs) and kept[-1]._jdf.queryExecution().debug().codegenToSeq()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    # The JVM leaves longer methods to its interpreter.
    assert max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) < 8000
    texts = [df for df in kept if "words" in df.columns]
    # Lines are told exactly, so no join makes rows that a second one has to drop.
    assert texts and all(df._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 1 for df in texts)
