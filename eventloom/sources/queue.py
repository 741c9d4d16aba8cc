"""Kafka as a source.  Needs the Kafka connector package on the session's class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def queue_options(brokers: list[str], topic: str, group: str, max_offsets: int | None = None) -> dict[str, str]:
    """Reads from the earliest offset; the stream's checkpoint takes the place of commits."""
    options = {
        "kafka.bootstrap.servers": ",".join(b.strip() for b in brokers if b.strip()),
        "subscribe": topic,
        "kafka.group.id": group,
        "startingOffsets": "earliest",
        "failOnDataLoss": "true",
    }
    if max_offsets:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return options


def queue_events(records: DataFrame) -> DataFrame:
    """Rows of a queue source as events; the position identifies a row."""
    return records.select(F.col("value").cast("string").alias("raw"), "topic", "partition", "offset",
                          F.col("timestamp").alias("ts"))


def read_queue(spark: SparkSession, brokers: list[str], topic: str, group: str,
               max_offsets: int | None = None) -> DataFrame:
    options = queue_options(brokers, topic, group, max_offsets)
    return queue_events(spark.readStream.format("kafka").options(**options).load())
