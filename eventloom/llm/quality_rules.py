"""Quality rules whose thresholds come from the data: mergeable quantile sketches per language and source.

The sketch is a histogram with logarithmic buckets: a bucket is a value cut to its five leading bits, so every quantile is
within 1/16 of the true one.  Sketches merge by adding counts; their size does not depend on the number of documents.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from eventloom.llm.common import SPACES, cut_lineage, map_batches, texts_of

MIN_WORDS = 50
# A group with fewer documents takes the sketch merged over its language, and that of all documents after it.
MIN_GROUP = 200


@dataclass(frozen=True)
class Rule:
    """``metric`` may lie within ``reach`` interquartile ranges, ``least`` at least, of the quartiles."""

    metric: str
    least: int
    reach: float = 3.0
    two_sided: bool = False


# Metrics are integers: characters a word in hundredths, shares in 1/10,000.
RULES = (
    Rule("word_length", 150, two_sided=True),
    Rule("symbol_share", 300),
    Rule("capital_share", 1500),
    Rule("dup_line_share", 3000),
    Rule("repeat_share", 1500),
)
_SCHEMA = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
           "n_lines bigint, n_capitals bigint")
MEASURES = [part.split()[0] for part in _SCHEMA.split(", ")]


def repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur at least twice; windows may overlap, words count once."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times, inside = Counter(windows), bytearray(len(words))
    for i, window in enumerate(windows):
        if times[window] > 1:
            inside[i:i + 3] = b"\1\1\1"
    return sum(inside)


def measure(text: bytes) -> tuple[int, ...]:
    words, packed = text.split(), text.translate(None, SPACES)
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    capitals = len(packed) - len(packed.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ!"))
    return (len(words), len(packed.decode("utf-8", "replace")), len(packed) - len(packed.translate(None, b"#*$%&|<>")),
            len(lines) - len(set(lines)), repeat_words(words), len(lines), capitals)


def measures(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and the counts of every whole text; a null text has no words."""

    def counted(batch: pa.RecordBatch) -> dict:
        found = [measure(t) for t in texts_of(batch.column("text"))]
        return {c: batch.column(c) for c in columns} | {
            name: pa.array([row[i] for row in found], pa.int64()) for i, name in enumerate(MEASURES)}

    chosen = docs.select(*columns, "text")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.drop("text").schema)
    return map_batches(chosen, counted, f"{shape}, {_SCHEMA}")


def metrics() -> dict[str, Column]:
    def share(part: str, whole: str) -> Column:
        return F.expr(f"coalesce(10000 * {part} div nullif({whole}, 0), 0)")

    return {
        "word_length": F.expr("coalesce(100 * word_chars div nullif(n_words, 0), 0)"),
        "symbol_share": share("n_symbols", "word_chars"),
        "capital_share": share("n_capitals", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
    }


def bucket(value: Column) -> Column:
    """The value with all but its five leading bits cleared."""
    width = F.length(F.bin(value))
    spare = F.greatest(width - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, spare), spare)


def sketches(measured: DataFrame) -> DataFrame:
    """``(lang, source, metric, bucket, n)`` of three levels; a merged level has null source, the last null lang too."""
    long = measured.select("lang", "source", F.explode(F.array(*(
        F.struct(F.lit(name).alias("metric"), bucket(value).alias("bucket")) for name, value in metrics().items()))).alias("m"))
    fine = long.groupBy("lang", "source", "m.metric", "m.bucket").agg(F.count("*").alias("n"))
    by_lang = fine.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    everywhere = by_lang.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    none = F.lit(None).cast("string")
    return fine.unionByName(by_lang.withColumn("source", none)).unionByName(
        everywhere.withColumn("lang", none).withColumn("source", none))


def thresholds(sketch: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a level and group, with ``low_<metric>`` and ``high_<metric>``, and its number of documents."""
    group = ["lang", "source", "metric"]
    upto = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sketch.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
    quartiles = ranked.groupBy(*group).agg(
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bucket"))).alias("q3"),
        F.max("total").alias("group_size"))
    made = [F.max("group_size").alias("group_size")]
    for rule in rules:
        slack = F.greatest((F.col("q3") - F.col("q1")) * F.lit(rule.reach), F.lit(float(rule.least)))
        own = F.col("metric") == rule.metric
        made.append(F.max(F.when(own, F.col("q3") + slack)).alias(f"high_{rule.metric}"))
        low = F.col("q1") - slack if rule.two_sided else F.lit(None).cast("double")
        made.append(F.max(F.when(own, low)).alias(f"low_{rule.metric}"))
    return quartiles.groupBy("lang", "source").agg(*made)


def judge_quality(docs: DataFrame, columns: list[str], rules: tuple[Rule, ...] = RULES,
                  min_group: int = MIN_GROUP) -> DataFrame:
    """``columns``, the counts, ``base_failed``, ``failed_rule`` (the first rule broken) and ``kept`` of every document.

    Null and empty texts have no words and fail the base.  Null languages and sources are groups of their own, as if
    empty.  Repeated rows are judged alike, an empty table gives an empty result, and ties lie inside a threshold.
    ``columns`` must not be called like a count.
    """
    named = docs.select(*(F.col(c).alias(f"_{c}") for c in columns), F.coalesce("lang", F.lit("")).alias("lang"),
                        F.coalesce("source", F.lit("")).alias("source"), "text")
    measured = cut_lineage(measures(named, [f"_{c}" for c in columns] + ["lang", "source"]))
    limits = thresholds(sketches(measured), rules)
    bounds = [c for c in limits.columns if c.startswith(("low_", "high_"))]
    as_one = F.struct(*bounds)
    own = limits.where(F.col("source").isNotNull() & (F.col("group_size") >= min_group)).select("lang", "source", as_one.alias("own"))
    by_lang = limits.where(F.col("source").isNull() & F.col("lang").isNotNull() & (F.col("group_size") >= min_group)).select(
        "lang", as_one.alias("by_lang"))
    # One row: a constant bound, so a broadcast is safe.
    every = limits.where(F.col("lang").isNull()).select(as_one.alias("every"))
    joined = measured.join(own, ["lang", "source"], "left").join(by_lang, "lang", "left").join(F.broadcast(every))
    joined = joined.withColumn("limit", F.coalesce("own", "by_lang", "every")).withColumns(metrics())
    broken = F.lit(None).cast("string")
    for rule in reversed(rules):
        value = F.col(rule.metric)
        outside = (value > F.col(f"limit.high_{rule.metric}")) | F.coalesce(value < F.col(f"limit.low_{rule.metric}"), F.lit(False))
        broken = F.when(outside, rule.metric).otherwise(broken)
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return joined.select(*(F.col(f"_{c}").alias(c) for c in columns), *MEASURES, base.alias("base_failed"),
                         broken.alias("failed_rule"), (~base & broken.isNull()).alias("kept"))
