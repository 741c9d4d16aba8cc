"""Which rows deletion and retention are about; ``rewrite`` applies them to a stored table."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from eventloom.functions.jsontext import strict_json, unquote
from eventloom.functions.paths import string_at
from eventloom.operators.joins import lookup_join
from eventloom.operators.nodes import is_text, json_nodes
from eventloom.operators.settle import settle
from eventloom.session import staged

_HOUR_US = 3_600_000_000
_NO_TIME = 2**62


def tenant_rows(tenant: str) -> Column:
    return F.col("tenant_id") == tenant


def event_rows(event_id: str) -> Column:
    return F.col("event_id") == event_id


def mentions_user(df: DataFrame, user: str, keep: tuple[str, ...]) -> DataFrame:
    """Keys of events that hold a member ``user_id`` with that text, at any depth.

    Only events whose text holds the id or an escape are taken apart.
    """
    may = F.contains("raw", F.lit(user)) | F.contains("raw", F.lit("\\"))
    valid = strict_json(F.col("raw")).isNotNull()
    parsed = settle(df.where(may).withColumn("raw", F.when(valid, F.col("raw"))), "raw")
    nodes = json_nodes(parsed, keep=keep).where(F.col("key") == "user_id")
    return nodes.where(is_text(F.col("value")) & (unquote(F.col("value")) == user)).select(*keep).distinct()


def user_rows(df: DataFrame, user: str, keep: tuple[str, ...]) -> DataFrame:
    """Keys of events of a user: by column, or by any ``user_id`` member of the event."""
    found = mentions_user(df, user, keep)
    if "user_id" not in df.columns:
        return found
    return found.union(df.where(F.col("user_id") == user).select(*keep)).distinct()


def delete_rows(df: DataFrame, doomed: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``df`` without the rows whose key is in ``doomed``; the table moves only if those are many."""
    return lookup_join(df, staged(doomed.select(*keep).distinct(), "doomed"), list(keep), "left_anti")


def deletion_report(kind: str, deleted: Column, reason: str = "") -> list[Column]:
    """Columns of the audit line of a deletion."""
    return [
        F.lit(kind).alias("type"), deleted.alias("deleted"), F.lit(reason).alias("reason"),
        F.current_timestamp().alias("timestamp"),
    ]


def older_than(at: str, now: datetime, days: int) -> Column:
    """Rows with a time before the cut-off; rows without a time stay."""
    cutoff = F.lit(now - timedelta(days=days))
    return F.col(at).isNotNull() & (F.col(at) < cutoff)


def retain_by_age(df: DataFrame, at: str, now: datetime, days: int) -> DataFrame:
    return df.where(~older_than(at, now, days))


def oldest_rows(df: DataFrame, at: str, tie: tuple[str, ...], count: int) -> Column:
    """A predicate for the ``count`` oldest rows, ties broken by a hash of ``tie``.

    The cut-off is narrowed down by counting: hours, then microseconds of the hour on the edge, then
    hashes within that microsecond.  Every step is a partial aggregation; no rows are sorted.  Rows
    without a time come last.
    """
    time, mark = F.coalesce(F.unix_micros(F.col(at)), F.lit(_NO_TIME)), F.xxhash64(*tie)
    steps = [
        F.floor(time / _HOUR_US), F.floor(time / 1_000_000), time,
        F.shiftright(mark, 48), F.shiftright(mark, 32), F.shiftright(mark, 16), mark,
    ]
    chosen, edge, left = F.lit(False), F.lit(True), count
    for step in steps:
        if left <= 0:
            break
        counts = df.where(edge).groupBy(step.alias("v")).agg(F.count("*").alias("n"))
        running = counts.orderBy("v").toLocalIterator()
        cut, before = None, 0
        for row in running:
            if before + row["n"] > left:
                cut = row["v"]
                break
            before += row["n"]
        if cut is None:
            return chosen | edge
        chosen, edge, left = chosen | (edge & (step < cut)), edge & (step == cut), left - before
    return chosen


def size_excess(df: DataFrame, max_bytes: int) -> int:
    """How many of the oldest rows must go: bytes over the limit divided by the average size, rounded up."""
    total = df.agg(F.sum(F.octet_length("raw")).alias("bytes"), F.avg(F.octet_length("raw")).alias("mean")).first()
    if not total["bytes"] or total["bytes"] <= max_bytes:
        return 0
    return math.ceil((total["bytes"] - max_bytes) / total["mean"])


def retain_by_size(df: DataFrame, at: str, tie: tuple[str, ...], max_bytes: int) -> DataFrame:
    """Drops the oldest rows until the raw texts fit the limit on average."""
    excess = size_excess(df, max_bytes)
    return df.where(~oldest_rows(df, at, tie, excess)) if excess else df


def tenant_of(df: DataFrame) -> DataFrame:
    """Adds the lifecycle columns a table without them needs, from ``doc``."""
    doc = F.col("doc")
    return df.withColumns({
        "tenant_id": F.coalesce(string_at(doc, "tenant_id"), string_at(doc, "tenant.id")),
        "user_id": F.coalesce(string_at(doc, "user_id"), string_at(doc, "user.id")),
    })
