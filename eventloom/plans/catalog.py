"""Registry of named queries: a Spark job and, where SQL can say the same, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventloom.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def load() -> None:
    """Imports the modules that register queries."""
    from eventloom.plans import queries_delivery, queries_events, queries_sources, queries_streams, queries_tables

    assert queries_delivery and queries_events and queries_sources and queries_streams and queries_tables
