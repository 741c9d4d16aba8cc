"""Counters and rates over outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

_RATES = "window_start timestamp, status string, events bigint, per_second double"


def outcome_counters(acked: DataFrame) -> DataFrame:
    """One row of totals; ``delivery`` columns are used where present."""
    status, duplicate = F.col("status"), F.coalesce(F.col("duplicate"), F.lit(False))
    sums = [
        F.count_if(status == "accepted").alias("events_accepted"),
        F.count_if(status == "invalid").alias("events_invalid"),
        F.count_if(status == "rejected").alias("events_rejected"),
        F.count_if(duplicate & (status == "accepted")).alias("events_deduped"),
    ]
    if "failure_count" in acked.columns:
        sums.append(F.coalesce(F.sum("failure_count"), F.lit(0)).alias("sink_write_errors"))
    if "schema_route" in acked.columns:
        route = F.col("schema_route")
        sums += [
            F.count_if(route == "warn").alias("schema_warnings"),
            F.count_if(route == "invalid").alias("schema_rejections"),
            F.count_if(route == "quarantine").alias("quarantine_writes"),
        ]
    if "dead_letter" in acked.columns:
        sums.append(F.count_if("dead_letter").alias("dlq_writes"))
    return acked.agg(*sums)


def observe_outcomes(acked: DataFrame, name: str = "outcomes") -> tuple[DataFrame, Observation]:
    """The same counters, collected while the rows pass; for streams and large writes."""
    seen = Observation(name)
    status = F.col("status")
    return acked.observe(
        seen,
        F.count_if(status == "accepted").alias("events_accepted"),
        F.count_if(status == "invalid").alias("events_invalid"),
        F.count_if(status == "rejected").alias("events_rejected"),
        F.count_if(F.coalesce("duplicate", F.lit(False))).alias("events_deduped"),
    ), seen


def outcome_rates(acked: DataFrame, at: str = "ts", width: str = "1 minute", late: str | None = None) -> DataFrame:
    """Events per second and status in tumbling windows.

    On a stream, ``late`` sets the watermark that closes windows.
    """
    timed = acked.withWatermark(at, late) if late else acked
    window = F.window(at, width)
    counted = timed.groupBy(window.alias("window"), "status").agg(F.count("*").alias("events"))
    seconds = F.unix_micros("window.end") - F.unix_micros("window.start")
    return counted.select(
        F.col("window.start").alias("window_start"), "status", "events",
        (F.col("events") * 1_000_000 / seconds).alias("per_second"),
    )


def write_panes(rates: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writes the windows of a stream of ``outcome_rates`` as often as they change, open ones too; ``read_panes`` merges them.

    Each batch has a folder of its own, which a repeated batch overwrites.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return rates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def read_panes(spark: SparkSession, path: str) -> DataFrame:
    """The windows as they are now: of each window and status, the row of the last batch that changed it."""
    panes = spark.read.schema(f"{_RATES}, batch bigint").parquet(path)
    last = F.max_by(F.struct("events", "per_second"), "batch").alias("last")
    return panes.groupBy("window_start", "status").agg(last).select("window_start", "status", "last.*")


def backlog_bytes(waiting: DataFrame, limit: int) -> DataFrame:
    """Bytes of undelivered events, line ends included, and whether they stay below the limit."""
    size = F.coalesce(F.sum(F.octet_length("raw") + 1), F.lit(0))
    return waiting.agg(size.alias("backlog_bytes"), F.count("*").alias("events")).withColumn(
        "healthy", F.col("backlog_bytes") <= limit)
