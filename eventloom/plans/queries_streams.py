"""Queries that run a stream to its end over the given tables and return what it wrote."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from eventloom.config import (
    DEFAULT_REGISTRY, DedupeRules, DeliveryRules, Limits, Privacy, RetryRules, SchemaRules, Settings,
)
from eventloom.functions.paths import string_at
from eventloom.operators.dead_letters import dlq_records
from eventloom.operators.governance import govern, parse_events
from eventloom.operators.metrics import outcome_rates, read_panes, write_panes
from eventloom.operators.registry import registry_table
from eventloom.plans.catalog import query
from eventloom.plans.queries_events import _DEDUPE_SQL, ROW, fold_sql
from eventloom.plans.wide_events import CODES_SQL, WIDE_SQL, read_table, wide_events, widen
from eventloom.session import scratch_path, staged
from eventloom.sources.backlog import consume_backlog, dlq_rows
from eventloom.streaming.dedupe import dedupe_stream
from eventloom.streaming.delivery import Sink, fanout_writer, parquet_sink, read_ledger
from eventloom.streaming.jobs import delivery_stream, read_backlog, redeliver


# So many tasks of the table write one file of a backlog, or a consumer that takes a few files at a time would take thousands of batches.
FILE_TASKS = 32


def event_stream(spark, sf_dir) -> DataFrame:
    """The events table as a stream of wide events."""
    schema = read_table(spark, sf_dir, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return widen(files)


def in_parts(rows: DataFrame, at: str, run: Callable[[DataFrame], None], parts: int = 3) -> None:
    """Appends ``rows`` to a folder in time order, one part at a time, and runs a stream over it after each.

    The rows are computed once, before the first part.
    """
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "arriving")
    rows = staged(rows, "to-arrive")
    first, last = rows.agg(F.min(at), F.max(at)).first()
    place = F.floor((F.unix_micros(at) - F.unix_micros(F.lit(first))) * parts
                    / (F.unix_micros(F.lit(last)) - F.unix_micros(F.lit(first)) + 1))
    for part in range(parts):
        rows.where(place == part).write.mode("append").parquet(path)
        run(spark.readStream.schema(rows.schema).parquet(path))


@query("dedupe_stream", _DEDUPE_SQL + fold_sql("keyed", "event_id", "INTERVAL 24 HOUR") + """
SELECT k.eid, k.copy, coalesce(w.duplicate, false) AS duplicate
FROM keyed k LEFT JOIN walk w ON k.eid = w.eid AND k.copy = w.copy""")
def stream_dedupe(spark, sf_dir):
    """The stateful stream, restarted twice, gives what the batch operator gives."""
    rows = parse_events(wide_events(spark, sf_dir)).where(F.col("doc").isNotNull())
    keyed = rows.select(*ROW, "ts", string_at(F.col("doc"), "event_id").alias("event_id"))
    out, log = scratch_path(spark, "dedupe"), scratch_path(spark, "dedupe-log")

    def run(arriving: DataFrame) -> None:
        judged = dedupe_stream(arriving, "event_id", "ts", ROW, timedelta(hours=24))
        judged.writeStream.format("parquet").option("path", out).option("checkpointLocation", log) \
            .trigger(availableNow=True).start().awaitTermination()

    in_parts(keyed, "ts", run)
    return spark.read.parquet(out).select(*ROW, "duplicate")


@query("stream_rates", f"""WITH {CODES_SQL}
SELECT date_trunc('hour', ts) AS window_start, CASE WHEN code IS NULL THEN 'accepted' ELSE 'invalid' END AS status,
  count(*) AS events FROM codes GROUP BY 1, 2""")
def stream_rates(spark, sf_dir):
    """Hourly counts of a stream that comes in three parts: every window, the last ones too."""
    base = scratch_path(spark, "rates")
    governed = govern(wide_events(spark, sf_dir)).select("ts", F.when(F.col("code").isNull(), "accepted").otherwise("invalid").alias("status"))

    def run(arriving: DataFrame) -> None:
        rated = outcome_rates(arriving, width="1 hour", late="1 hour")
        write_panes(rated, f"{base}/panes", f"{base}/log").trigger(availableNow=True).start().awaitTermination()

    in_parts(governed, "ts", run)
    panes = read_panes(spark, f"{base}/panes")
    return panes.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "status", "events")


@query("stream_delivery", f"""WITH {CODES_SQL}
SELECT sink, eid, copy FROM codes, (VALUES ('primary'), ('spare')) s(sink) WHERE code IS NULL""")
def stream_delivery(spark, sf_dir):
    """A governed stream fanned out: the primary takes every event, a broken secondary sends it to the fallback."""
    base = scratch_path(spark, "delivery")

    def broken(batch: DataFrame, batch_id: int) -> None:
        raise OSError("no space left")

    def rows(batch: DataFrame) -> DataFrame:
        return batch.select(*ROW, "ts", "raw")

    sinks = (
        Sink("primary", "primary", parquet_sink(f"{base}/primary", rows)),
        Sink("s1", "secondary", broken),
        Sink("spare", "fallback", parquet_sink(f"{base}/spare", rows)),
    )
    settings = Settings(
        delivery=DeliveryRules(fallback_enabled=True, fallback_on_secondary=True),
        retry=RetryRules(enabled=False),
    )
    running = delivery_stream(
        event_stream(spark, sf_dir), settings, registry_table(spark, DEFAULT_REGISTRY), sinks,
        checkpoint=f"{base}/log", outcome_path=f"{base}/outcomes", dlq_path=f"{base}/dlq",
    ).trigger(availableNow=True).start()
    running.awaitTermination()
    schema = "eid bigint, copy int, ts timestamp, raw string, batch_id string"
    parts = [spark.read.schema(schema).parquet(f"{base}/{s}").select(F.lit(s).alias("sink"), *ROW)
             for s in ("primary", "spare")]
    return parts[0].unionByName(parts[1])


@query("retry_ledger", """
WITH placed AS (
  SELECT event_id, floor((epoch_us(ts) - epoch_us(min(ts) OVER ())) * 3 / (epoch_us(max(ts) OVER ()) - epoch_us(min(ts) OVER ()) + 1))::BIGINT AS batch
  FROM events)
SELECT event_id AS eid, batch, sink, CASE sink WHEN 'primary' THEN 1 ELSE batch + 1 END AS attempts,
  CASE sink WHEN 'primary' THEN 0 ELSE [0, 10, 30][batch + 1] END AS waited_ms, true AS delivered
FROM placed, (VALUES ('primary'), ('s1')) sinks(sink)""")
def retry_ledger(spark, sf_dir):
    """Attempts and waits of every event as the ledger of a stream has them; the second sink fails once more in each batch."""
    base, calls = scratch_path(spark, "retried"), Counter()
    keep = parquet_sink(f"{base}/s1")

    def flaky(batch: DataFrame, batch_id: int) -> None:
        calls[batch_id] += 1
        if calls[batch_id] <= batch_id:
            raise OSError("not yet")
        keep(batch, batch_id)

    sinks = (Sink("primary", "primary", parquet_sink(f"{base}/primary")), Sink("s1", "secondary", flaky))
    write = fanout_writer(sinks, DeliveryRules(policy="require_all"), RetryRules(initial_backoff=0.01, jitter=False),
                          ledger_path=f"{base}/ledger")

    def run(arriving: DataFrame) -> None:
        arriving.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/log").trigger(
            availableNow=True).start().awaitTermination()

    rows = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("eid"), F.col("ts").cast("timestamp").alias("ts"))
    in_parts(rows, "ts", run)
    tried = read_ledger(spark, f"{base}/ledger").groupBy("batch", "sink").agg(
        F.count("*").alias("attempts"), F.round(F.sum("waited") * 1000).cast("long").alias("waited_ms"), F.bool_or("ok").alias("delivered"))
    shape = "eid bigint, ts timestamp, batch_id string"
    written = [spark.read.schema(shape).parquet(f"{base}/{sink}").select(
        "eid", F.col("batch_id").cast("long").alias("batch"), F.lit(sink).alias("sink")) for sink in ("primary", "s1")]
    return written[0].unionByName(written[1]).join(tried, ["batch", "sink"]).select(
        "eid", "batch", "sink", "attempts", "waited_ms", "delivered")


@query("backlog_twice", f"""WITH {WIDE_SQL}, lines AS (SELECT raw, json_valid(raw) AS good FROM wide)
SELECT consumer, kind, count(*) AS lines, CAST(sum(strlen(raw)) AS BIGINT) AS bytes
FROM lines, (VALUES ('sinks'), ('queue')) c(consumer), (VALUES ('event'), ('bad')) k(kind)
WHERE (kind = 'event' AND good) OR (kind = 'bad' AND NOT good AND consumer = 'sinks') GROUP BY 1, 2""")
def backlog_twice(spark, sf_dir):
    """Two consumers of one backlog, each run twice and once more after a second part arrived: every line once for each."""
    base = scratch_path(spark, "backlog")

    def consume(consumer: str, bad_path: str | None) -> None:
        keep = parquet_sink(f"{base}/{consumer}")
        consume_backlog(read_backlog(spark, f"{base}/lines", 3), f"{base}/{consumer}-position", keep, bad_path).trigger(
            availableNow=True).start().awaitTermination()

    rows = wide_events(spark, sf_dir)
    files = max(spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions() // FILE_TASKS)
    for part in range(2):
        rows.where(F.pmod("eid", F.lit(2)) == part).select("raw").coalesce(files).write.text(f"{base}/lines/part={part}")
        for _ in range(2):
            consume("sinks", f"{base}/bad")
        if part:
            consume("queue", None)
    shape = "raw string"
    parts = [spark.read.schema(shape).parquet(f"{base}/{c}").select(F.lit(c).alias("consumer"), F.lit("event").alias("kind"), "raw")
             for c in ("sinks", "queue")]
    parts.append(spark.read.schema(shape).json(f"{base}/bad").select(F.lit("sinks").alias("consumer"), F.lit("bad").alias("kind"), "raw"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("consumer", "kind").agg(
        F.count("*").alias("lines"), F.sum(F.octet_length("raw")).alias("bytes"))


@query("dlq_redeliver", f"""WITH {CODES_SQL}, again AS (
  SELECT raw, code IN ('attr_count_exceeded', 'attr_depth_exceeded', 'string_too_long') AS good FROM codes WHERE code IS NOT NULL
)
SELECT count(*) FILTER (good) AS accepted, count(*) AS replayed, count(*) FILTER (good) AS delivered,
  CAST(sum(strlen(raw)) FILTER (good) AS BIGINT) AS bytes FROM again""")
def dlq_redeliver(spark, sf_dir):
    """Dead letters the whole way again with the limits off, twice under the same number, and what the sink has then."""
    base = scratch_path(spark, "redelivered")
    failed = govern(wide_events(spark, sf_dir)).where(F.col("code").isNotNull())
    # Governed and taken apart once, for both replays.
    records = staged(dlq_rows(dlq_records(failed.withColumn("first_error", F.col("code")), F.col("ts")).select(
        F.to_json(F.struct("timestamp", "error", "raw")).alias("value"))).select("dlq_id", "raw_event"), "to-replay")
    settings = Settings(limits=Limits(enabled=False), privacy=Privacy(mode="off"))
    sinks = (Sink("primary", "primary", parquet_sink(f"{base}/primary", lambda rows: rows.select("raw"))),)
    for _ in range(2):
        counts = redeliver(records, 0, settings, registry_table(spark, DEFAULT_REGISTRY), sinks, ledger_path=f"{base}/ledger")
    delivered = spark.read.schema("raw string").parquet(f"{base}/primary")
    return delivered.agg(F.lit(counts[0]).cast("long").alias("accepted"), F.lit(counts[1]).cast("long").alias("replayed"),
                         F.count("*").alias("delivered"), F.sum(F.octet_length("raw")).alias("bytes"))


@query("stream_pipeline", "WITH RECURSIVE " + CODES_SQL + """,
judged AS (
  SELECT eid, copy, ts,
    CASE WHEN code IS NOT NULL THEN 'invalid'
         WHEN NOT json_exists(raw, '$.event_id') OR NOT json_exists(raw, '$.timestamp') THEN 'quarantine' END AS failed,
    CASE WHEN json_type(raw, '$.event_id') = 'VARCHAR' THEN raw ->> '$.event_id' END AS event_id
  FROM (SELECT * EXCLUDE (raw), CASE WHEN code = 'expected_json_object' THEN '{}' ELSE raw END AS raw FROM codes)
), keyed AS (SELECT * FROM judged WHERE failed IS NULL),
""" + fold_sql("keyed", "event_id", "INTERVAL 24 HOUR") + """,
routed AS (
  SELECT coalesce(failed, CASE WHEN w.duplicate THEN 'duplicate' ELSE 'accepted' END) AS route
  FROM judged j LEFT JOIN walk w ON j.eid = w.eid AND j.copy = w.copy
)
SELECT route, count(*) AS events, CASE WHEN route = 'duplicate' THEN 0 ELSE count(*) END AS written FROM routed GROUP BY 1""")
def stream_pipeline(spark, sf_dir):
    """The whole stream in three parts: events per route as counted, and as read back from where each route is written."""
    base = scratch_path(spark, "whole")
    settings = Settings(schema=SchemaRules(mode="quarantine"), dedupe=DedupeRules(enabled=True),
                        retry=RetryRules(enabled=False))
    registry = registry_table(spark, DEFAULT_REGISTRY)
    sinks = (Sink("primary", "primary", parquet_sink(f"{base}/accepted", lambda rows: rows.select(*ROW, "ts", "raw"))),)

    def run(arriving: DataFrame) -> None:
        delivery_stream(arriving, settings, registry, sinks, f"{base}/log", f"{base}/invalid", f"{base}/quarantine", "ts",
                        ROW, route_path=f"{base}/routes").trigger(availableNow=True).start().awaitTermination()

    in_parts(wide_events(spark, sf_dir), "ts", run)
    counted = spark.read.schema("route string, events bigint").parquet(f"{base}/routes").groupBy("route").agg(
        F.sum("events").alias("events"))
    shape = "timestamp string, error string, raw string"
    places = [spark.read.schema("eid bigint").parquet(f"{base}/accepted").select(F.lit("accepted").alias("route"))]
    places += [spark.read.schema(shape).json(f"{base}/{route}").select(F.lit(route).alias("route"))
               for route in ("invalid", "quarantine")]
    written = places[0].unionByName(places[1]).unionByName(places[2]).groupBy("route").agg(F.count("*").alias("written"))
    return counted.join(written, "route", "left").select(
        "route", "events", F.coalesce("written", F.lit(0).cast("bigint")).alias("written"))
