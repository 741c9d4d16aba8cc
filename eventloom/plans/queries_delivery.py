"""Queries over delivery outcomes, counters, rates and push payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eventloom.config import DeliveryRules, RetryRules
from eventloom.functions.paths import string_at
from eventloom.operators.delivery import evaluate_delivery
from eventloom.operators.governance import govern
from eventloom.operators.metrics import backlog_bytes, outcome_counters, outcome_rates
from eventloom.operators.projection import canonical_event
from eventloom.operators.responses import acks
from eventloom.plans.catalog import query
from eventloom.plans.queries_events import objects
from eventloom.plans.wide_events import CODES_SQL, OBJECTS_SQL, WIDE_SQL, read_table, wide_events
from eventloom.sinks.push_payloads import loki_batches, otlp_records

_SINKS = (("primary", "primary", 7), ("s1", "secondary", 5), ("s2", "secondary", 11), ("spare", "fallback", 13))


def outcomes(spark, sf_dir) -> DataFrame:
    """``(event_key, sink, role, ok, error)``: four sink writes per event, some of them failed."""
    eid = F.col("event_id")
    writes = F.array(*(
        F.struct(F.lit(sink).alias("sink"), F.lit(role).alias("role"),
                 (F.pmod(eid, F.lit(n)) != 0).alias("ok"),
                 F.when(F.pmod(eid, F.lit(n)) == 0, F.lit(f"{sink} down")).alias("error"))
        for sink, role, n in _SINKS))
    rows = read_table(spark, sf_dir, "events").select(eid.alias("event_key"), F.explode(writes).alias("w"))
    return rows.select("event_key", "w.*")


_VERDICTS_SQL = """
base AS (
  SELECT event_id AS event_key, event_id % 7 <> 0 AS p, event_id % 5 <> 0 AS a, event_id % 11 <> 0 AS b,
         event_id % 13 <> 0 AS f FROM events
), judged AS (
  SELECT event_key, policy, p, f, CAST(a AS INTEGER) + CAST(b AS INTEGER) AS won, 2 - CAST(a AS INTEGER) - CAST(b AS INTEGER) AS lost, a,
    CASE policy WHEN 'best_effort' THEN p OR a OR b WHEN 'require_all' THEN p AND a AND b ELSE p END AS delivered
  FROM base, (VALUES ('best_effort'), ('require_all'), ('require_primary')) m(policy)
), tried AS (
  SELECT *, (NOT delivered) OR lost > 0 AS fallback_attempted,
    CASE WHEN delivered THEN NULL ELSE 'delivery policy ' || policy || ' failed (primary_failed=' ||
      CASE WHEN p THEN 'false' ELSE 'true' END || ' secondary_failures=' || lost || ' secondary_success=' || won || ')'
    END AS policy_error
  FROM judged
)"""


def _verdicts(spark, sf_dir) -> DataFrame:
    parts = []
    for policy in ("best_effort", "require_all", "require_primary"):
        rules = DeliveryRules(policy=policy, fallback_enabled=True, fallback_on_secondary=True, dlq_enabled=True)
        parts.append(evaluate_delivery(outcomes(spark, sf_dir), rules).withColumn("policy", F.lit(policy)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("delivery_policy", f"""WITH {_VERDICTS_SQL}
SELECT event_key, policy, delivered, p AS primary_ok, CAST(won AS BIGINT) AS secondary_success,
  CAST(lost AS BIGINT) AS secondary_failures, policy_error FROM tried""")
def delivery_policy(spark, sf_dir):
    return _verdicts(spark, sf_dir).select(
        "event_key", "policy", "delivered", "primary_ok", "secondary_success", "secondary_failures", "policy_error")


@query("fallback_dlq", f"""WITH {_VERDICTS_SQL}
SELECT event_key, policy, fallback_attempted,
  (NOT p) OR (fallback_attempted AND NOT f) OR NOT delivered AS dead_letter,
  coalesce(CASE WHEN fallback_attempted AND NOT f THEN 'spare down' END, CASE WHEN NOT p THEN 'primary down' END,
    CASE WHEN lost > 0 THEN CASE WHEN NOT a THEN 's1 down' ELSE 's2 down' END END, policy_error) AS first_error,
  CAST((NOT p)::INTEGER + lost + (fallback_attempted AND NOT f)::INTEGER AS BIGINT) AS failure_count
FROM tried""")
def fallback_dlq(spark, sf_dir):
    return _verdicts(spark, sf_dir).select(
        "event_key", "policy", "fallback_attempted", "dead_letter", "first_error", "failure_count")


def _acked(spark, sf_dir) -> DataFrame:
    """Acknowledged events: refused by governance, or rejected where the primary sink failed."""
    failed = F.when(F.pmod("eid", F.lit(7)) == 0, F.lit("primary down"))
    rows = govern(wide_events(spark, sf_dir).withColumn("came", F.col("raw"))).withColumns(
        {"delivery_error": failed, "duplicate": F.col("copy") == 1})
    return acks(rows)


_ACKED_SQL = CODES_SQL + """,
acked AS (
  SELECT eid, copy, ts, raw, copy = 1 AS duplicate, CASE WHEN code IS NOT NULL THEN 'invalid'
    WHEN copy <> 1 AND eid % 7 = 0 THEN 'rejected' ELSE 'accepted' END AS status FROM codes
)"""


@query("outcome_counters", f"""WITH {_ACKED_SQL}
SELECT count(*) FILTER (status = 'accepted') AS events_accepted, count(*) FILTER (status = 'invalid') AS events_invalid,
  count(*) FILTER (status = 'rejected') AS events_rejected,
  count(*) FILTER (status = 'accepted' AND duplicate) AS events_deduped FROM acked""")
def counters(spark, sf_dir):
    return outcome_counters(_acked(spark, sf_dir))


@query("outcome_rates", f"""WITH {_ACKED_SQL}
SELECT date_trunc('minute', ts) AS window_start, status, count(*) AS events, count(*) / 60.0::DOUBLE AS per_second
FROM acked GROUP BY 1, 2""")
def rates(spark, sf_dir):
    """Events per second and status in minutes."""
    rated = outcome_rates(_acked(spark, sf_dir))
    return rated.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("backlog_bytes", f"""WITH {_ACKED_SQL}
SELECT CAST(sum(strlen(raw) + 1) AS BIGINT) AS backlog_bytes, count(*) AS events, false AS healthy
FROM acked WHERE status = 'rejected'""")
def backlog(spark, sf_dir):
    """Bytes, as they came, of the events that no sink took yet."""
    waiting = _acked(spark, sf_dir).where(F.col("status") == "rejected")
    return backlog_bytes(waiting.withColumn("raw", F.col("came")), limit=1000)


@query("loki_batches", f"""WITH {WIDE_SQL}
SELECT count(*) AS lines, CAST(sum(strlen(raw)) AS BIGINT) AS bytes, count(DISTINCT raw) AS texts, 0::BIGINT AS too_long,
  'eventloom' AS app FROM wide""")
def loki(spark, sf_dir):
    """Push bodies taken apart again: every line once, no body over its size."""
    labels = {" app ": " eventloom ", "bad-name": "x"}
    bodies = loki_batches(wide_events(spark, sf_dir), labels, at=F.col("ts"), size=100, max_bytes=40_000)
    shape = "streams array<struct<stream: map<string,string>, values: array<array<string>>>>"
    over = (F.col("lines") > 100) | ((F.octet_length("payload") > 40_000) & (F.col("lines") > 1))
    stream = bodies.select(over.alias("over"), F.from_json("payload", shape)["streams"][0].alias("s"))
    lines = stream.select("over", F.element_at("s.stream", F.lit("app")).alias("app"),
                          F.map_keys("s.stream").alias("names"), F.explode("s.values").alias("v"))
    return lines.groupBy("app").agg(
        F.count("*").alias("lines"), F.sum(F.octet_length(F.col("v")[1])).alias("bytes"),
        # Told apart by 32 bytes each, not by kilobytes of text.
        F.countDistinct(F.unhex(F.sha2(F.col("v")[1], 256))).alias("texts"), F.count_if("over").alias("too_long"))


@query("otlp_records", f"""WITH {OBJECTS_SQL}
SELECT eid, copy, 9 AS severity, md5(raw) AS digest, coalesce(raw ->> '$.event', '') AS event_name,
  coalesce(CASE WHEN json_type(raw, '$.event_id') = 'VARCHAR' THEN raw ->> '$.event_id' END, '') AS event_id,
  CASE WHEN json_exists(raw, '$.timestamp') THEN CAST(epoch_us(ts) * 1000 AS VARCHAR) END AS nanos
FROM objects""")
def records(spark, sf_dir):
    """Events as OTLP log records."""
    rows = objects(spark, sf_dir)
    typed = canonical_event(rows.withColumn("text", F.col("raw")), keep=("eid", "copy", "raw"))
    out = otlp_records(typed, keep=("eid", "copy"))
    record = F.col("record")
    return out.select(
        "eid", "copy", record["severityNumber"].alias("severity"), F.md5(record["body"]["stringValue"]).alias("digest"),
        record["eventName"].alias("event_name"), record["attributes"][0]["value"]["stringValue"].alias("event_id"),
        record["timeUnixNano"].alias("nanos"))


@query("service_of_dead", f"""WITH {CODES_SQL}
SELECT coalesce(CASE WHEN code <> 'expected_json_object' THEN raw ->> '$.service' END, 'none') AS service, code, count(*) AS events
FROM (SELECT code, CASE WHEN code = 'expected_json_object' THEN '{{}}' ELSE raw END AS raw FROM codes WHERE code IS NOT NULL) GROUP BY 1, 2""")
def service_of_dead(spark, sf_dir):
    """Which service sends the events that are refused, and why."""
    rows = govern(wide_events(spark, sf_dir)).where(F.col("code").isNotNull())
    service = F.coalesce(string_at(F.col("doc"), "service"), F.lit("none"))
    return rows.groupBy(service.alias("service"), "code").agg(F.count("*").alias("events"))
