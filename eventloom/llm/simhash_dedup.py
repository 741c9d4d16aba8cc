"""SimHash near-dedup: fingerprints of word shingles, linked through deletion-variant signatures.

A 64-bit fingerprint is cut into two halves.  Two fingerprints with at most three differing bits have a half that differs
by at most one bit, and such halves agree once that bit is wildcarded.  Every distinct fingerprint is indexed under the 32
one-wildcard variants of each half; an equality join finds the candidates and a population count verifies them.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from eventloom.llm.common import cut_lineage, map_batches, texts_of
from eventloom.llm.components import connected_components

WORDS = 3
DISTANCE = 3
_HASH = partial(xxhash.xxh64_intdigest, seed=42)
_CHUNK = 50_000  # hashes whose bits are unpacked at a time
_HALF = 0xFFFFFFFF


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Majority of the bits of all shingle hashes; zero for a text without words."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        return _HASH(b" ".join(tokens))
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
    hashes = np.fromiter(map(_HASH, shingles), "<u8", len(tokens) - words + 1)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = hashes[i:i + _CHUNK].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, columns: list[str], words: int = WORDS) -> DataFrame:
    """``columns`` of every document and its ``fp``; a null text has no words."""

    def measured(batch: pa.RecordBatch) -> dict:
        made = {c: batch.column(c) for c in columns}
        prints = np.array([fingerprint(t, words) for t in texts_of(batch.column("text"))], np.uint64)
        return made | {"fp": pa.array(prints.view(np.int64))}

    chosen = docs.select(*columns, "text") if "text" not in columns else docs.select(*columns)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.select(*columns).schema) + ", fp bigint"
    return map_batches(chosen, measured, shape)


def _half(fp: Column, segment: Column) -> Column:
    return F.when(segment == 0, fp.bitwiseAND(F.lit(_HALF))).otherwise(F.shiftrightunsigned(fp, 32))


def signatures(prints: DataFrame) -> DataFrame:
    """``(key, fp)``: 64 variants of every fingerprint, each half with one bit wildcarded."""
    variant = prints.select("fp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("n"))
    segment = F.shiftright("n", 5)
    bit = F.expr("shiftleft(1L, cast(n & 31 as int))")
    kept = _half(F.col("fp"), segment).bitwiseAND(F.bitwise_not(bit))
    return variant.select(kept.bitwiseOR(F.shiftleft("n", 32)).alias("key"), "fp")


def links(prints: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints that differ in at most three bits, each once.

    A pair meets under several variants; it counts under that of the first half with at most one differing bit.
    """
    index = signatures(prints)
    left, right = index.select("key", F.col("fp").alias("a")), index.select("key", F.col("fp").alias("b"))
    differing = F.col("a").bitwiseXOR(F.col("b"))
    low, high = differing.bitwiseAND(F.lit(_HALF)), F.shiftrightunsigned(differing, 32)

    def place(half: Column) -> Column:
        return F.when(half == 0, 0).otherwise(F.bit_count(half - 1))

    own = F.when(F.bit_count(low) <= 1, place(low)).otherwise(place(high) + 32)
    verified = (F.bit_count(differing) <= DISTANCE) & (F.shiftrightunsigned("key", 32) == own)
    # Spark takes the 64 variants to be as small as the fingerprints they come from, and would broadcast them.
    return left.join(right.hint("merge"), "key").where((F.col("a") < F.col("b")) & verified).select("a", "b")


def _rooted(docs: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """``columns``, ``fp``, ``component_id`` and ``root``, a fingerprint that only the documents of one group share."""
    prints = cut_lineage(fingerprints(docs, columns))
    classes = prints.groupBy("fp").agg(F.min(id_column).alias("least"))
    joined = connected_components(links(classes.select("fp")), "a", "b")
    of_class = classes.join(joined, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root"))
    least = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(of_class.select("fp", "root").join(least, "root"), "fp")


def near_groups(docs: DataFrame, id_column: str, keep: list[str] | None = None) -> DataFrame:
    """``id_column``, the columns ``keep``, ``fp`` and ``component_id`` of every document.

    Documents with the same fingerprint are one class, so groups of copies are never expanded; links run between
    classes.  ``component_id`` is the smallest id reachable.  Null ids are never the smallest; a component of
    nothing but null ids has a null ``component_id``.  Repeated rows are documents of their own with one
    fingerprint.  An empty table gives an empty result.
    """
    return _rooted(docs, id_column, [id_column, *(c for c in keep or [] if c != id_column)]).drop("root")


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_dedup(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One document of each group: that of the smallest id, null ids last (of several rows of that id, the first by content).

    Ids need not be unique: two groups that share their smallest id, or have none, keep a document each.
    """
    columns = docs.columns
    grouped = _rooted(docs.select(id_column, "text", F.struct(*columns).alias("_all")), id_column, [id_column, "_all"])
    kept = grouped.where(F.col(id_column).eqNullSafe(F.col("component_id")))
    return kept.groupBy("root").agg(F.min("_all").alias("_all")).select("_all.*")
