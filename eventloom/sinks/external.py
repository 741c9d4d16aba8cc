"""Kafka and JDBC sinks.  Their connector jars must be on the session's class path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F


def kafka_rows(df: DataFrame) -> DataFrame:
    """Value only, no key: the partitioner of the queue spreads the events."""
    return df.select(F.col("raw").alias("value"))


def kafka_options(brokers: list[str], topic: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": ",".join(b.strip() for b in brokers if b.strip()), "topic": topic}


def write_kafka(df: DataFrame, brokers: list[str], topic: str) -> None:
    kafka_rows(df).write.format("kafka").options(**kafka_options(brokers, topic)).save()


def jdbc_options(url: str, table: str, driver: str, batch_size: int = 10_000, connections: int = 32) -> dict[str, str]:
    """``connections`` bounds how many tasks write at the same time."""
    return {"url": url, "dbtable": table, "driver": driver, "batchsize": str(batch_size),
            "numPartitions": str(connections)}


def postgres_options(url: str, table: str, **more: int) -> dict[str, str]:
    # The raw column is JSONB there; untyped strings let the server convert the text.
    return {**jdbc_options(url, table, "org.postgresql.Driver", **more), "stringtype": "unspecified"}


def clickhouse_options(url: str, table: str, **more: int) -> dict[str, str]:
    return jdbc_options(url, table, "com.clickhouse.jdbc.ClickHouseDriver", **more)


def write_jdbc(rows: DataFrame, options: dict[str, str]) -> None:
    rows.write.format("jdbc").options(**options).mode("append").save()


def jdbc_sink(options: dict[str, str], rows: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A sink for ``fanout_writer``."""
    return lambda batch, batch_id: write_jdbc(rows(batch), options)
