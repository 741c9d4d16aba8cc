"""Read-only SQL and text search over stored events."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# What a read-only statement starts with, and the greatest number of rows in one reply.
READ_ONLY_STARTS = ("select", "with", "show", "describe", "pragma table_info")
MAX_ROWS = 1000


def is_read_only(statement: str) -> bool:
    text = statement.strip().lower()
    return text.startswith(READ_ONLY_STARTS) and ";" not in text


def run_query(spark: SparkSession, statement: str, tables: Mapping[str, DataFrame], limit: int | None = None) -> DataFrame:
    """All rows, or the first ``limit``, of a read-only statement over the given tables; Spark SQL plans and runs it."""
    if not is_read_only(statement):
        raise ValueError("query_must_be_read_only")
    text = statement.strip()
    if text.lower().startswith("pragma table_info"):
        # The spelling of ``describe`` that this statement stands for.
        text = "describe " + text[len("pragma table_info"):].strip().strip("()").strip("'\"")
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    found = spark.sql(text)
    return found if limit is None else found.limit(limit)


def query_result(df: DataFrame, limit: int = MAX_ROWS) -> dict[str, object]:
    """``{columns, rows, row_count, truncated}`` of one reply; ``truncated`` tells whether there are more rows."""
    found = df.limit(limit + 1).collect()
    rows = [row.asDict() for row in found[:limit]]
    return {"columns": df.columns, "rows": rows, "row_count": len(rows), "truncated": len(found) > limit}


def contains_text(raw: Column, text: str) -> Column:
    """A literal substring; unlike LIKE, ``%`` and ``_`` stand for themselves."""
    return F.contains(raw, F.lit(text))


def search_events(df: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    found = df.where(contains_text(F.col("raw"), text))
    return found if limit is None else found.limit(limit)


def search_count(df: DataFrame, text: str) -> DataFrame:
    return df.where(contains_text(F.col("raw"), text)).agg(F.count("*").alias("matches"))
