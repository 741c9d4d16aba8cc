"""How far the sources of a language differ in their words, on run-length columns.

The vocabulary of a language is reordered so that terms with equal counts stand together, and cut into blocks.  In a block each
(language, source) group is a run-length encoded column of counts.  For two groups the borders of their runs are intersected, and
f is taken once per piece and multiplied by its length; sums over blocks are added up.

Counting is done where the documents are: a task holds a bounded table of (group, term) counts and gives it out when it is full,
so a word or source that holds a third of all rows moves as one row per task.  All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from eventloom.llm.common import cut_lineage, texts_of

MIN_DOCUMENTS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
# Counts a task holds before it gives them out, terms in a block, and sources compared in one go with as many others.
HELD_COUNTS = 300_000
BLOCK_TERMS = 8192
TILE = 128

# ASCII letters in lower case; other ASCII characters separate terms, and all bytes of other characters stay.
_FOLD = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))

_COLUMN = "lang string, block bigint, size int, source string, lengths array<int>, counts array<bigint>"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text, in order: runs of letters A-Z, in lower case, and of characters beyond ASCII."""
    return text.translate(_FOLD).split()


def named(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``, pre-aggregated: occurrences and documents; a key may come several times."""

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, in_docs) in held.items():
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), terms,
                 pa.array(n.values(), pa.int64()), pa.array((in_docs[t] for t in n), pa.int64())],
                names=["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(lambda: (Counter(), Counter()))
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))):
                found = Counter(terms_of(text))
                n, in_docs = held[lang, source]
                n.update(found)
                in_docs.update(found.keys())
            if sum(len(n) for n, _ in held.values()) > HELD_COUNTS:
                yield from rows(held)
                held.clear()
        yield from rows(held)

    return docs.select(named("lang").alias("lang"), named("source").alias("source"), "text").mapInArrow(
        count, "lang string, source string, term string, n bigint, docs bigint")


def kept_terms(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``(lang, term, n, counts)``: terms in enough documents of a language; ``counts`` is ``struct(source, n)``, by source.

    A term has at most one entry per source, so a row grows with the sources, not with the documents.
    """
    by_term = term_counts(docs).repartition("lang", "term")
    by_source = by_term.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_lang = by_source.groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return by_lang.where(F.col("docs") >= min_documents).select("lang", "term", "n", "counts")


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``(lang, source, n_group, n_lang, n_terms, tile)`` for every group that occurs, also those without terms."""
    groups = docs.select(named("lang").alias("lang"), named("source").alias("source")).distinct()
    sums = kept.select("lang", F.inline("counts")).groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count("*").alias("n_terms"))
    known = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return known.withColumn("tile", F.floor(place / TILE).cast("int"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 5) / (total + 5 * terms)), exact: the product has up to 38 digits."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTHING).cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", above, (total + SMOOTHING * terms).cast("decimal(20,0)"))


def shares(counts: np.ndarray, divisor: int) -> np.ndarray:
    """``share`` for an array of counts; whole numbers of any size, one division per distinct count."""
    distinct, place = np.unique(counts, return_inverse=True)
    return np.array([1 + SCALE * (c + SMOOTHING) // divisor for c in distinct.tolist()], np.int64)[place]


def run_length_columns(kept: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(lang, block, size, source, lengths, counts)``: per block and source, the counts of its terms as runs.

    Terms are dealt out by their total and sorted by their counts, so that equal ones stand together; a block holds consecutive terms of one
    language.  A source without any of a block's terms has no column there.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        for lang, parts in _blocks(batches, block_terms):
            size = sum(len(p) for p in parts)
            term = np.concatenate([np.repeat(np.arange(len(p)) + at, p.value_lengths().to_numpy())
                                   for p, at in zip(parts, np.cumsum([0] + [len(p) for p in parts]))])
            entries = pa.concat_arrays([p.flatten() for p in parts])
            coded = entries.field("source").dictionary_encode()
            source, count = coded.indices.to_numpy(), entries.field("n").to_numpy()
            order = np.lexsort((term, source))
            borders = np.searchsorted(source[order], np.arange(len(coded.dictionary) + 1))
            lengths, counts = [], []
            for first, last in zip(borders, borders[1:]):
                column = np.zeros(size, np.int64)
                column[term[order[first:last]]] = count[order[first:last]]
                begin = np.flatnonzero(np.diff(column, prepend=column[0] - 1))
                lengths.append(np.diff(begin, append=size))
                counts.append(column[begin])
            n = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([base + made] * n, pa.int64()), pa.array([size] * n, pa.int32()),
                 coded.dictionary, pa.array(lengths, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                names=["lang", "block", "size", "source", "lengths", "counts"])
            made += 1

    # The driver samples what terms are dealt out by: two numbers, where the counts are as wide as a language has sources.
    dealt = kept.repartitionByRange("lang", "n", F.xxhash64("counts"))
    clustered = dealt.sortWithinPartitions("lang", "counts")
    return clustered.select("lang", "counts").mapInArrow(encode, _COLUMN)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, list[pa.ListArray]]]:
    """Consecutive rows of one language, ``size`` at most, as ``(lang, pieces of counts)``."""
    lang, parts, held = None, [], 0
    for batch in batches:
        langs = batch.column(0).to_pylist()
        at = 0
        while at < len(langs):
            if parts and (langs[at] != lang or held == size):
                yield lang, parts
                parts, held = [], 0
            lang, end = langs[at], at
            while end < len(langs) and langs[end] == lang and held + end - at < size:
                end += 1
            parts.append(batch.column(1).slice(at, end - at))
            held, at = held + end - at, end
    if parts:
        yield lang, parts


def intersected_sum(ends: np.ndarray, p: np.ndarray, other_ends: np.ndarray, other_p: np.ndarray) -> int:
    """Sum of abs(p - q) over two columns given by where their runs end and their values."""
    borders = np.union1d(ends, other_ends)
    f = np.abs(p[np.searchsorted(ends, borders)] - other_p[np.searchsorted(other_ends, borders)])
    return int((f * np.diff(borders, prepend=0)).sum())


def pair_sums(columns: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for every ordered pair of a language's sources.

    Sources are taken ``TILE`` by ``TILE``: a task holds two tiles of columns of one block.  A language's first block is an
    empty one, so that pairs of a language without terms have their row too.
    """
    blocks = columns.select("lang", "block", "size").distinct()
    nothing = groups.select("lang", F.lit(-1).cast("long").alias("block"), F.lit(0).alias("size")).distinct()
    tiles = groups.groupBy("lang").agg(F.max("tile").alias("last_tile"))
    everywhere = blocks.unionByName(nothing).join(groups, "lang").join(tiles, "lang")
    filled = everywhere.join(columns.drop("size"), ["lang", "block", "source"], "left").select(
        "lang", "block", "source", "tile",
        # A group without any of the terms has one run of zeros.
        F.coalesce("lengths", F.array("size")).alias("lengths"), F.coalesce("counts", F.array(F.lit(0).cast("long"))).alias("counts"),
        (F.col("n_group") + SMOOTHING * F.col("n_terms")).alias("divisor"),
        F.explode(F.sequence(F.lit(0), "last_tile")).alias("other"))
    key = ["lang", "block", "low", "high"]
    met = filled.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
    ordered = met.repartition(*key).sortWithinPartitions(*key, "source").select(
        *key, "source", "tile", "lengths", "counts", "divisor")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        for (lang, _, low, high), members in groupby(rows, key=lambda row: row[:4]):
            coded = [(source, tile, np.cumsum(lengths), shares(np.array(counts, np.int64), max(divisor, 1)))
                     for *_, source, tile, lengths, counts, divisor in members]
            for place, (source, tile, ends, p) in enumerate(coded):
                for item, other_tile, other_ends, other_p in coded[place + 1:]:
                    if low == high or tile != other_tile:
                        sums[lang, source, item] += intersected_sum(ends, p, other_ends, other_p)
            if len(sums) > HELD_COUNTS:
                yield _pairs(sums)
                sums.clear()
        if sums:
            yield _pairs(sums)

    partial = ordered.mapInArrow(add_up, "lang string, source string, item string, value bigint")
    both = partial.unionByName(partial.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    return both.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _pairs(sums: Counter) -> pa.RecordBatch:
    langs, sources, items = zip(*sums)
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(items, pa.string()),
         pa.array(list(sums.values()), pa.int64())], names=["lang", "source", "item", "value"])


def top_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: terms a group has more of than its language, by how much."""
    cells = kept.select("lang", "term", F.col("n").alias("n_all"), F.inline("counts")).join(groups, ["lang", "source"])
    own = share(F.col("n"), F.col("n_group"), F.col("n_terms"))
    whole = share(F.col("n_all"), F.col("n_lang"), F.col("n_terms"))
    return cells.select("lang", "source", F.col("term").alias("item"), (own - whole).alias("value")).where("n > 0 and value > 0")


def ranked(rows: DataFrame, part: str) -> DataFrame:
    """With ``part`` and ``rank`` within each group: greatest value first, then the item's bytes."""
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit_sources(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS,
                  block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: per group its distance to each other source, and its most telling terms.

    Null texts, languages and sources count as empty strings, so rows without them form groups of their own.  Texts are counted
    whole; repeated rows count as often as they are there.  Ties go by the item's bytes.  A language without kept terms has pairs
    of distance zero and no terms; an empty table gives an empty result.  Other columns of ``docs`` do not matter.

    The answer has a row for each ordered pair of sources, which is what grows fastest; everything else grows with the
    vocabulary.  Kept terms, groups and columns are written to the shared folder, as each is read more than once.
    """
    kept = cut_lineage(kept_terms(docs, min_documents))
    groups = cut_lineage(group_sizes(docs, kept))
    columns = cut_lineage(run_length_columns(kept, block_terms))
    terms = ranked(top_terms(kept, groups), "term").where(F.col("rank") <= top)
    return ranked(pair_sums(columns, groups), "pair").unionByName(terms)
