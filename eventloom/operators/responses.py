"""Acknowledgements per event and responses per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def acks(df: DataFrame) -> DataFrame:
    """Adds ``status``, ``reason``, ``ack_code``, ``ack_message`` and ``retryable``.

    Reads ``code``/``message`` (invalid), ``duplicate`` and, if present, ``delivery_error``
    (rejected, may be sent again).
    """
    code, duplicate = F.col("code"), F.coalesce(F.col("duplicate"), F.lit(False))
    failed = F.col("delivery_error") if "delivery_error" in df.columns else F.lit(None).cast("string")
    rejected = code.isNull() & ~duplicate & failed.isNotNull()
    name = (
        F.when(code.isNotNull(), F.when(code == "", "invalid").otherwise(code))
        .when(duplicate, "duplicate_event_id").when(rejected, "delivery_failed").otherwise("accepted")
    )
    text = F.when(code.isNotNull(), F.coalesce(F.nullif(F.col("message"), F.lit("")), name)).when(
        duplicate, "duplicate event accepted by idempotency").when(rejected, failed).otherwise("event accepted")
    return df.withColumns({
        "status": F.when(code.isNotNull(), "invalid").when(rejected, "rejected").otherwise("accepted"),
        "reason": name, "ack_code": name, "ack_message": text, "retryable": rejected,
    })


def response_status(accepted: Column, invalid: Column, rejected: Column) -> Column:
    return (
        F.when((accepted > 0) & (invalid + rejected > 0), "partial").when(accepted > 0, "accepted")
        .when(invalid > 0, "invalid").otherwise("rejected")
    )


def http_status(accepted: Column, invalid: Column, rejected: Column) -> Column:
    return (
        F.when((accepted == 0) & (invalid > 0) & (rejected == 0), 400)
        .when((accepted == 0) & (rejected > 0), 503)
        .when((accepted > 0) & (invalid + rejected > 0), 207).otherwise(202)
    )


def batch_response(acked: DataFrame, request: str = "request_id", with_acks: bool = False) -> DataFrame:
    """Counts and status per request.

    ``with_acks`` adds the list of acknowledgements; a request holds a limited number of events, so
    the list is bounded by the request limits.
    """
    status = F.col("status")
    counts = [
        F.count_if(status == "accepted").alias("accepted"),
        F.count_if(status == "invalid").alias("invalid"),
        F.count_if(status == "rejected").alias("rejected"),
        F.count_if(F.coalesce("duplicate", F.lit(False)) & (status == "accepted")).alias("duplicates"),
    ]
    if with_acks:
        one = F.struct("index", "event_id", "status", "retryable", "reason",
                       F.col("ack_code").alias("code"), F.col("ack_message").alias("message"), "duplicate")
        counts.append(F.array_sort(F.collect_list(one)).alias("acks"))
    totals = acked.groupBy(request).agg(*counts)
    numbers = F.col("accepted"), F.col("invalid"), F.col("rejected")
    return totals.withColumn("status", response_status(*numbers)).withColumn("http_status", http_status(*numbers))
