"""Dead-letter files and undelivered backlogs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from eventloom.functions.crypto import decrypt_column
from eventloom.functions.jsontext import closed_pair, strict_json, trim, value_of_pair
from eventloom.functions.paths import string_at
from eventloom.operators.registry import failure_records
from eventloom.operators.settle import settle


def dlq_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """Dead-letter lines as rows ``(dlq_id, event_id, timestamp, error, raw, raw_event, line)``.

    A line that is not a JSON object becomes its own ``raw_event``.  A record without ``dlq_id`` gets
    one from its content, so ids stay the same when other records are deleted.
    """
    line = trim(F.col(column))
    rows = lines.select(line.alias("line")).where(F.col("line") != "")
    rows = rows.withColumn("_pair", F.when(F.startswith("line", F.lit("{")), closed_pair(F.col("line"))))
    rows = rows.withColumn("_doc", value_of_pair(F.col("_pair"), F.col("line")))
    rows = settle(rows.drop("_pair"), "_doc")
    doc, bad = F.col("_doc"), F.col("_doc").isNull()
    given = F.try_variant_get(doc, "$.dlq_id", "string")
    raw = string_at(doc, "raw")
    derived = F.sha2(F.concat_ws("|", F.coalesce(string_at(doc, "timestamp"), F.lit("")),
                                 F.coalesce(raw, F.col("line"))), 256)
    listed = rows.select(
        F.coalesce(given, derived).alias("dlq_id"),
        F.try_variant_get(doc, "$.event_id", "string").alias("event_id"),
        string_at(doc, "timestamp").alias("timestamp"),
        F.when(bad, "dlq_record_invalid_json").otherwise(string_at(doc, "error")).alias("error"),
        raw.alias("raw"),
        F.when(bad, F.col("line")).otherwise(F.coalesce(raw, string_at(doc, "raw_event"))).alias("raw_event"),
        "line",
    )
    return settle(listed, "dlq_id", "event_id", "error")


def read_dlq(spark: SparkSession, path: str) -> DataFrame:
    return dlq_rows(spark.read.text(path))


def _checked(lines: DataFrame, column: str) -> DataFrame:
    """``raw`` of every line that is not blank, and ``_bad``: whether it is no JSON value."""
    text = F.col(column)
    # Trimming lists every byte; a text from brace to brace has nothing to trim.
    bare = F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}"))
    rows = settle(lines.select(F.when(bare, text).otherwise(trim(text)).alias("raw")), "raw").where(F.col("raw") != "")
    return settle(rows.withColumn("_bad", strict_json(F.col("raw")).isNull()), "_bad")


def _parted(checked: DataFrame, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    bad = checked.where("_bad").withColumn("reason", F.lit("invalid_spool_record"))
    return checked.where(~F.col("_bad")).drop("_bad"), failure_records(bad, "reason", at).withColumnRenamed(
        "error", "reason")


def split_backlog(lines: DataFrame, column: str = "value", at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Undelivered lines as events (``raw``), and the bad ones as ``(timestamp, reason, raw)``."""
    return _parted(_checked(lines, column), at)


def replay_backlog(spark: SparkSession, path: str, bad_path: str) -> DataFrame:
    """Events of a whole backlog, in batch; its bad lines go to a folder of the backlog's own below ``bad_path``.

    A second replay replaces that folder instead of adding the lines again.
    """
    good, bad = split_backlog(spark.read.text(path))
    bad.write.mode("overwrite").json(f"{bad_path}/backlog={hashlib.sha256(path.encode()).hexdigest()[:16]}")
    return good


def consume_backlog(lines: DataFrame, position: str, write: Callable[[DataFrame, int], None], bad_path: str | None = None,
                    column: str = "value", passphrase: str = "") -> DataStreamWriter:
    """One consumer of a backlog, a stream of undelivered lines; start it with ``.start()``.

    ``position`` is the consumer's own checkpoint: it says which files it has read, so any number of consumers go through the same
    backlog at their own pace, and a consumer that is run again takes only what is new.  ``write(events, batch_id)`` gets the good
    lines as ``raw``; it must be safe to repeat for the same batch.  Bad lines go to ``bad_path``, a folder per batch that a
    repeated batch overwrites; only one consumer of a backlog should be given it.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        # Kept with the verdict, so that no line is parsed again for the bad ones and for the sink.
        checked = _checked(batch.select(decrypt_column(F.col(column), passphrase).alias("value")), "value").persist()
        try:
            good, bad = _parted(checked)
            if bad_path and not bad.isEmpty():
                bad.write.mode("overwrite").json(f"{bad_path}/batch={batch_id}")
            write(good, batch_id)
        finally:
            checked.unpersist()

    return lines.writeStream.foreachBatch(take).option("checkpointLocation", position)
