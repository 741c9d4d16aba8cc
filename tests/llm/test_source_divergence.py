"""Source divergence against sums over all terms."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

from eventloom.llm import queries
from eventloom.llm import source_divergence as sd

DOCS = "doc_id long, text string, lang string, source string, term string, n int"


def audited(rows, min_documents=30, top=50):
    """The contract, term by term."""
    groups, in_docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
        groups[lang or "", source or ""].update(words)
        in_docs[lang or ""].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in in_docs[lang].items() if n >= min_documents]
        whole = Counter()
        for (of, _), counts in groups.items():
            whole.update({t: counts[t] for t in kept} if of == lang else {})

        def shares(counts):
            total = sum(counts[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // total for t in kept}

        p = {source: shares(counts) for (of, source), counts in groups.items() if of == lang}
        q = shares(whole)
        for source, own in p.items():
            pairs = [(-sum(abs(own[t] - other[t]) for t in kept), item.encode()) for item, other in p.items() if item != source]
            terms = [(q[t] - own[t], t.encode()) for t in kept if groups[lang, source][t] and own[t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, source, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def some_rows(seed=4, n=900):
    rng = random.Random(seed)
    words = ["the", "The", "naïve", "x-ray", "tab\tbed", "Ünder", "日本", "a1b", "don't", *(f"{a}{b}" for a in "bcdfg" for b in "aeiou")]
    rows = []
    for n in range(n):
        lang = rng.choice(["en"] * 4 + ["de", None, "", "few"]) if n > 5 else "lone"
        source = None if rng.random() < .1 else "hot" if rng.random() < .4 else f"s{rng.randrange(7)}"
        text = None if rng.random() < .05 else " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 10, 60])))
        rows.append((n // 2, text, "few" if n % 97 == 0 else lang, source))
    return [*rows, *rows[:40], (1, "the " * 200_000, "en", "s1"), (2, "...", "none", "empty"), (3, None, "none", "other")]


def test_against_all_terms(spark):
    rows = some_rows()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS).repartition(5)
    want = audited(rows)
    assert sorted(map(tuple, sd.audit_sources(docs).collect())) == want
    # Blocks, tiles and full tables of counts change nothing.
    sd_tile, sd.TILE = sd.TILE, 2
    sd_held, sd.HELD_COUNTS = sd.HELD_COUNTS, 20
    try:
        assert sorted(map(tuple, sd.audit_sources(docs, block_terms=3).collect())) == want
    finally:
        sd.TILE, sd.HELD_COUNTS = sd_tile, sd_held
    assert any(r[2] == "pair" and r[4] == 0 for r in want) and len({r[0] for r in want}) > 4


def test_empty_table(spark):
    assert sd.audit_sources(spark.createDataFrame([], DOCS)).collect() == []


def test_runs_of_columns(spark):
    kept = [("en", f"t{n}", 9, [("a", 1 + n % 3), *([("b", 2)] if n % 2 else [])]) for n in range(50)] + [("de", "t", 1, [("a", 1)])]
    columns = sd.run_length_columns(spark.createDataFrame(kept, "lang string, term string, n bigint, counts array<struct<source: string, n: bigint>>"), 16)
    totals = Counter()
    for c in columns.collect():
        assert sum(c.lengths) == c["size"] <= 16 and all(a != b for a, b in zip(c.counts, c.counts[1:]))
        totals[c.lang, c.source] += sum(n * m for n, m in zip(c.lengths, c.counts))
    assert totals == {("en", "a"): sum(1 + n % 3 for n in range(50)), ("en", "b"): 50, ("de", "a"): 1}
    a, b = np.array([2, 5, 9]), np.array([1, 5, 6, 9])
    p, q = np.array([1, 7, 3]), np.array([4, 4, 0, 8])
    assert sd.intersected_sum(a, p, b, q) == np.abs(np.repeat(p, [2, 3, 4]) - np.repeat(q, [1, 4, 1, 3])).sum()
    big = np.array([0, 3, 10**13])
    assert sd.shares(big, 10**14).tolist() == [1 + 10**9 * (int(c) + 5) // 10**14 for c in big]


def test_query_and_sql(spark, tmp_path):
    rows = some_rows(9, 500)
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_source_divergence"](spark, str(tmp_path))
    tables = duckdb.connect()
    tables.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    twin = tables.execute(queries.SQL["op11_source_divergence"])
    assert [c[0] for c in twin.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(twin.fetchall()) == audited(rows)
    assert dict(got.dtypes)["rank"] == "int" and dict(got.dtypes)["value"] == "bigint"
