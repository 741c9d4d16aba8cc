"""Queries over request bodies, OTLP exports and dead-letter lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from eventloom.config import Limits, RequestLimits, Settings
from eventloom.functions.jsontext import strict_json, trim
from eventloom.operators.dead_letters import dlq_records, dlq_replay, dlq_show, dlq_without, replay_counts
from eventloom.operators.governance import govern
from eventloom.operators.responses import acks, batch_response
from eventloom.plans.catalog import query
from eventloom.plans.wide_events import CODES_SQL, WIDE_SQL, read_table, wide_events
from eventloom.session import staged
from eventloom.sources.backlog import dlq_rows, split_backlog
from eventloom.sources.otlp import OtlpSettings, flatten_otlp_logs
from eventloom.sources.payloads import decode_bodies, explode_payloads, read_unpacked_batches, request_guards, split_ndjson

REQUEST_EVENTS = 50

# Bodies of requests with 50 events each, in three forms; a few are cut off or blank.
_REQUESTS_SQL = f"""
items AS (
  SELECT eid // {REQUEST_EVENTS} AS request_id, eid, copy,
    CASE WHEN (eid // {REQUEST_EVENTS}) % 3 < 2 AND raw = '{{bad' THEN '"x"' ELSE raw END AS item,
    row_number() OVER (PARTITION BY eid // {REQUEST_EVENTS} ORDER BY eid, copy) - 1 AS index
  FROM wide
), bodies AS (
  SELECT request_id, count(*) AS n, min(CASE WHEN index = 0 THEN item END) AS first_item,
    CASE WHEN request_id % 40 = 8 THEN '  ' || chr(10) ELSE
      CASE request_id % 3 WHEN 0 THEN '[' || string_agg(item, ', ' ORDER BY index) || CASE WHEN request_id % 40 = 7 THEN '' ELSE ']' END
        WHEN 1 THEN '{{"api_version":"1","events":[' || string_agg(item, ',' ORDER BY index) ||
             CASE WHEN request_id % 40 = 7 THEN ']' ELSE ']}}' END
        ELSE string_agg(item, chr(10) ORDER BY index) END END AS payload,
    CASE request_id % 4 WHEN 0 THEN 'application/json; charset=utf-8' WHEN 1 THEN '' WHEN 2 THEN 'application/x-ndjson'
      ELSE CASE WHEN request_id % 40 = 11 THEN 'text/plain' ELSE 'Application/JSON' END END AS content_type
  FROM items GROUP BY request_id
), judged AS (
  SELECT *, CASE
      WHEN request_id % 40 = 8 THEN 'empty'
      WHEN request_id % 40 = 7 AND request_id % 3 < 2 THEN 'invalid'
      WHEN request_id % 3 = 2 AND first_item LIKE '[%' THEN 'invalid' ELSE 'good' END AS state
  FROM bodies
)"""


def requests(spark, sf_dir) -> DataFrame:
    """``(request_id, payload, content_type)``: request bodies with the wide events of 50 rows each."""
    request = F.floor(F.col("eid") / REQUEST_EVENTS).alias("request_id")
    shape = F.pmod("request_id", F.lit(3))
    rows = wide_events(spark, sf_dir).select("eid", "copy", "raw", request)
    item = F.when((shape < 2) & (F.col("raw") == "{bad"), F.lit('"x"')).otherwise(F.col("raw"))
    grouped = rows.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("eid", "copy", item.alias("item")))).alias("rows"))

    def joined(separator: str) -> Column:
        return F.array_join(F.transform("rows", lambda r: r["item"]), separator)

    cut = F.pmod("request_id", F.lit(40)) == 7
    body = (
        F.when(shape == 0, F.concat(F.lit("["), joined(", "), F.when(cut, "").otherwise("]")))
        .when(shape == 1, F.concat(F.lit('{"api_version":"1","events":['), joined(","), F.when(cut, "]").otherwise("]}")))
        .otherwise(joined("\n"))
    )
    blank = F.pmod("request_id", F.lit(40)) == 8
    quarter = F.pmod("request_id", F.lit(4))
    kind = (
        F.when(quarter == 0, "application/json; charset=utf-8").when(quarter == 1, "")
        .when(quarter == 2, "application/x-ndjson")
        .when(F.pmod("request_id", F.lit(40)) == 11, "text/plain").otherwise("Application/JSON")
    )
    return grouped.select("request_id", F.when(blank, F.lit("  \n")).otherwise(body).alias("payload"),
                          kind.alias("content_type"))


@query("payload_explode", f"""WITH {WIDE_SQL}, {_REQUESTS_SQL}
SELECT i.request_id, CAST(i.index AS INTEGER) AS index, md5(i.item) AS digest
FROM items i JOIN judged j ON i.request_id = j.request_id WHERE j.state = 'good'""")
def payload_explode(spark, sf_dir):
    """Every event of every valid body, byte for byte."""
    rows = explode_payloads(requests(spark, sf_dir))
    return rows.select("request_id", "index", F.md5("raw").alias("digest"))


@query("ndjson_split", f"""WITH {WIDE_SQL}, {_REQUESTS_SQL}
SELECT request_id, CASE WHEN request_id % 40 = 8 THEN 0 WHEN request_id % 3 = 2 THEN CAST(n AS INTEGER) ELSE 1 END AS lines FROM bodies""")
def ndjson_split(spark, sf_dir):
    """Lines per body; one that is no NDJSON is a single line, a blank one has none."""
    return requests(spark, sf_dir).select("request_id", F.size(split_ndjson(F.col("payload"))).alias("lines"))


_KINDS = ("plain.json", "one.gz", "one.zst", "two.gz", "two.zst", "cut.gz", "cut.zst", "junk.zst")


@query("payload_files", f"""WITH {WIDE_SQL}, {_REQUESTS_SQL}, encoded AS (
  SELECT request_id, payload, {list(_KINDS)}[request_id % {len(_KINDS)} + 1] AS kind, strlen(payload) > 60000 AS big FROM bodies
)
SELECT request_id || '-' || kind AS request_id, kind NOT LIKE 'cut%' AND kind NOT LIKE 'junk%' AND big AS too_large,
  CASE WHEN kind NOT LIKE 'cut%' AND kind NOT LIKE 'junk%' AND NOT big THEN md5(payload) END AS digest
FROM encoded""")
def payload_files(spark, sf_dir):
    """Bodies in gzip and zstd, of one or two members or frames; cut off and damaged ones give nothing, over-long ones are told."""

    @F.pandas_udf("binary")
    def encode(payloads: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([encoded(text.encode(), kind) for text, kind in zip(payloads, kinds)])

    def encoded(body: bytes, kind: str) -> bytes:
        import gzip

        import zstandard

        pack = gzip.compress if kind.endswith(".gz") else zstandard.ZstdCompressor().compress
        how = kind.split(".")[0]
        if how == "plain":
            return body
        if how == "two":
            return pack(body[:len(body) // 3]) + pack(body[len(body) // 3:])
        if how in ("cut", "junk"):
            # Short of the size limit; a cut body ends inside its frame, though all of the text may have come out by then.
            return pack(body[:9000])[:-3] if how == "cut" else pack(body[:9000]) + b"\x01\x02"
        return pack(body)

    rows = requests(spark, sf_dir).withColumn("kind", F.get(
        F.array(*map(F.lit, _KINDS)), F.pmod("request_id", F.lit(len(_KINDS))).cast("int")))
    bodies = rows.select(F.concat_ws("-", "request_id", "kind").alias("request_id"), encode("payload", "kind").alias("content"))
    return decode_bodies(bodies, RequestLimits(max_body_bytes=60_000)).select(
        "request_id", "too_large", F.md5("payload").alias("digest"))


_TIGHT = RequestLimits(max_body_bytes=62_000, max_events=55)


@query("request_guards", f"""WITH {WIDE_SQL}, {_REQUESTS_SQL}, coded AS (
SELECT request_id, CASE WHEN content_type = 'text/plain' THEN 'unsupported_content_type'
    WHEN strlen(payload) > {_TIGHT.max_body_bytes} THEN 'payload_too_large'
    WHEN state = 'invalid' THEN 'invalid_request_payload' WHEN state = 'empty' THEN 'empty_event_payload'
    WHEN n > {_TIGHT.max_events} THEN 'max_events_exceeded' END AS request_error FROM judged)
SELECT request_id, request_error, CASE WHEN request_error = 'unsupported_content_type' THEN 415
  WHEN request_error IN ('payload_too_large', 'max_events_exceeded') THEN 413
  WHEN request_error IS NOT NULL THEN 400 END AS http_status FROM coded""")
def guards(spark, sf_dir):
    return request_guards(requests(spark, sf_dir), _TIGHT).select("request_id", "request_error", "http_status")


@query("batch_response", f"""WITH {CODES_SQL}, {_REQUESTS_SQL},
answers AS (
  SELECT i.request_id, count(*) FILTER (c.code IS NULL) AS accepted, count(*) FILTER (c.code IS NOT NULL) AS invalid
  FROM items i JOIN judged j ON i.request_id = j.request_id JOIN codes c ON c.eid = i.eid AND c.copy = i.copy
  WHERE j.state = 'good' GROUP BY i.request_id
)
SELECT request_id, accepted, invalid, CAST(0 AS BIGINT) AS rejected,
  CASE WHEN accepted > 0 AND invalid > 0 THEN 'partial' WHEN accepted > 0 THEN 'accepted' ELSE 'invalid' END AS status,
  CASE WHEN accepted > 0 AND invalid > 0 THEN 207 WHEN accepted > 0 THEN 202 ELSE 400 END AS http_status
FROM answers""")
def response(spark, sf_dir):
    """Bodies taken apart, every event governed and acknowledged, one answer per request."""
    events = govern(explode_payloads(requests(spark, sf_dir)))
    acked = acks(events.withColumn("duplicate", F.lit(False)))
    return batch_response(acked).drop("duplicates")


@query("event_acks", f"""WITH {CODES_SQL}, {_REQUESTS_SQL}
SELECT i.request_id, CAST(i.index AS INTEGER) AS index, coalesce(c.code, 'accepted') AS reason,
  coalesce(c.message, 'event accepted') AS message, c.code IS NULL AS ok
FROM items i JOIN judged j ON i.request_id = j.request_id JOIN codes c ON c.eid = i.eid AND c.copy = i.copy
WHERE j.state = 'good'""")
def event_acks(spark, sf_dir):
    events = govern(explode_payloads(requests(spark, sf_dir)))
    acked = acks(events.withColumn("duplicate", F.lit(False)))
    return acked.select("request_id", "index", "reason", F.col("ack_message").alias("message"),
                        (F.col("status") == "accepted").alias("ok"))


@query("unpacked_batches", f"""WITH {WIDE_SQL}
SELECT eid // 50 AS batch_id, count(*) AS events, CAST(sum(strlen(raw)) AS BIGINT) AS bytes
FROM wide WHERE raw <> '"x"' GROUP BY 1""")
def unpacked_batches(spark, sf_dir):
    """Typed batches of raw events; empty members are skipped (one of the broken texts is emptied)."""
    rows = wide_events(spark, sf_dir).withColumn(
        "raw_json", F.when(F.col("raw") != '"x"', F.col("raw")).when(F.pmod("eid", F.lit(3)) == 0, ""))
    batches = rows.groupBy(F.floor(F.col("eid") / 50).alias("batch_id")).agg(
        F.collect_list(F.struct("raw_json")).alias("events"))
    return read_unpacked_batches(batches).groupBy("batch_id").agg(
        F.count("*").alias("events"), F.sum(F.octet_length("raw")).alias("bytes"))


# --- OTLP -------------------------------------------------------------------------------------

def exports(spark, sf_dir) -> DataFrame:
    """``(request_id, payload)``: OTLP log exports of 50 rows of ``events`` each."""

    def attribute(key: str, kind: str, value: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), F.struct(value.alias(kind)).alias("value"))

    eid = F.col("event_id")
    nanos = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.pmod(eid, F.lit(7))
    no_time = F.pmod(eid, F.lit(100)) == 3
    # Attributes differ in type, so the list is put together as text.
    attributes = F.concat(
        F.lit("["), F.to_json(attribute("user", "stringValue", F.concat(F.lit("u-"), F.col("user_id")))), F.lit(","),
        F.to_json(attribute("n", "intValue", eid.cast("string"))), F.lit(","),
        F.to_json(attribute("value", "doubleValue", F.col("value"))), F.lit(","),
        F.to_json(attribute("odd", "boolValue", F.pmod(eid, F.lit(2)) == 1)),
        F.when(F.pmod(eid, F.lit(10)) == 0, F.lit(',{"key":"region","value":{"stringValue":"record"}}')).otherwise(""),
        F.when(F.pmod(eid, F.lit(10)) == 1, F.concat(
            F.lit(',{"key":"nested","value":{"kvlistValue":{"values":[{"key":"list","value":{"arrayValue":{"values":'
                  '[{"intValue":"'), eid, F.lit('"},{"stringValue":"z"}]}}}]}}}'))).otherwise(""),
        F.lit("]"),
    )
    body = F.when(F.pmod(eid, F.lit(4)) == 0, F.concat(F.lit('{"intValue":"'), eid, F.lit('"}'))) \
        .when(F.pmod(eid, F.lit(50)) == 1, F.lit('{"stringValue":"  "}')) \
        .otherwise(F.concat(F.lit('{"stringValue":"'), F.col("event_type"), F.lit('"}')))
    record = F.concat(
        F.lit('{"timeUnixNano":"'), F.when(no_time, F.lit(0)).otherwise(nanos), F.lit('","observedTimeUnixNano":"'),
        nanos, F.lit('","severityText":" '), F.when(F.col("event_type") == "error", "ERROR").otherwise("Info"),
        F.lit(' ","body":'), body, F.lit(',"attributes":'), attributes, F.lit("}"),
    )
    rows = read_table(spark, sf_dir, "events").select(
        F.floor(eid / 50).alias("request_id"), F.struct(eid, record.alias("record")).alias("r"))
    grouped = rows.groupBy("request_id").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    service = F.when(F.pmod("request_id", F.lit(5)) == 4, F.lit("")).otherwise(
        F.concat(F.lit("svc_"), F.pmod("request_id", F.lit(5))))
    environment = F.when(F.pmod("request_id", F.lit(2)) == 0, F.lit(
        ',{"key":"deployment.environment","value":{"stringValue":"prod"}}')).otherwise("")
    return grouped.select("request_id", F.concat(
        F.lit('{"resourceLogs":[{"resource":{"attributes":[{"key":"region","value":{"stringValue":"eu"}},'
              '{"key":"service.name","value":{"stringValue":"'), service, F.lit('"}}'), environment,
        F.lit(']},"scopeLogs":[{"logRecords":['), F.array_join(F.transform("rows", lambda r: r["record"]), ","),
        F.lit("]}]}]}")).alias("payload"))


@query("otlp_flatten", """
SELECT event_id // 50 AS request_id, event_id AS n,
  'otlp_' || CASE WHEN event_id % 100 = 3 THEN 0 ELSE epoch_us(ts) * 1000 + event_id % 7 END AS event_id,
  epoch_us(ts) * 1000 + event_id % 7 AS time_unix_nano,
  rtrim(rtrim(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || lpad(CAST(event_id % 7 AS VARCHAR), 3, '0'), '0'), '.') || 'Z' AS timestamp,
  CASE WHEN (event_id // 50) % 5 = 4 THEN 'fallback' ELSE 'svc_' || ((event_id // 50) % 5) END AS service,
  CASE WHEN event_id % 4 = 0 THEN CAST(event_id AS VARCHAR) WHEN event_id % 50 = 1 THEN 'otlp.log' ELSE event_type END AS event,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level,
  CASE WHEN event_id % 10 = 0 THEN 'record' ELSE 'eu' END AS region,
  'u-' || user_id AS user, value, event_id % 2 = 1 AS odd,
  CASE WHEN event_id % 10 = 1 THEN event_id END AS nested_n, CASE WHEN event_id % 10 = 1 THEN 'z' END AS nested_text,
  CASE WHEN (event_id // 50) % 2 = 0 THEN 'prod' END AS environment, 'otlp' AS sdk
FROM events""")
def otlp_flatten(spark, sf_dir):
    """One wide event per log record of the exports."""
    events = flatten_otlp_logs(exports(spark, sf_dir), OtlpSettings(default_service="fallback"), keep=("request_id",))
    doc = events.withColumn("doc", F.try_parse_json("raw"))

    def text(path: str, kind: str = "string") -> Column:
        return F.try_variant_get("doc", path, kind)

    return doc.select(
        "request_id", text("$.attrs.n", "bigint").alias("n"), text("$.event_id").alias("event_id"), "time_unix_nano",
        text("$.timestamp").alias("timestamp"), text("$.service").alias("service"), text("$.event").alias("event"),
        text("$.level").alias("level"), text("$.attrs.region").alias("region"), text("$.attrs.user").alias("user"),
        text("$.attrs.value", "double").alias("value"), text("$.attrs.odd", "boolean").alias("odd"),
        text("$.attrs.nested.list[0]", "bigint").alias("nested_n"),
        text("$.attrs.nested.list[1]").alias("nested_text"),
        text("$.deployment.environment").alias("environment"), text("$.source.sdk").alias("sdk"))


@query("otlp_governed", """
SELECT CASE WHEN (event_id // 50) % 5 = 4 THEN 'otlp' ELSE 'svc_' || ((event_id // 50) % 5) END AS service, count(*) AS events
FROM events GROUP BY 1""")
def otlp_governed(spark, sf_dir):
    """Flattened records pass governance like any other event."""
    passed = govern(flatten_otlp_logs(exports(spark, sf_dir))).where(F.col("code").isNull())
    return passed.groupBy(F.try_variant_get("doc", "$.service", "string").alias("service")).agg(
        F.count("*").alias("events"))


# --- dead letters -----------------------------------------------------------------------------

def dead_lines(spark, sf_dir) -> DataFrame:
    """Dead-letter lines of all events that governance refuses; about one in 16 is damaged on the way."""
    failed = govern(wide_events(spark, sf_dir)).where(F.col("code").isNotNull())
    records = dlq_records(failed.withColumn("first_error", F.col("code")), F.col("ts"))
    line = F.to_json(F.struct("timestamp", "error", "raw"))
    broken = F.startswith(F.md5(F.col("timestamp")), F.lit("0"))
    return records.select(F.when(broken, F.concat(F.lit("cut "), line)).otherwise(line).alias("value"))


_DLQ_SQL = """WITH """ + CODES_SQL + """,
dead AS (
  SELECT eid, copy, code, raw, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS stamp FROM codes WHERE code IS NOT NULL
)"""


@query("dlq_records", _DLQ_SQL + " SELECT code AS error, stamp AS timestamp, md5(raw) AS digest FROM dead")
def dead_letter_records(spark, sf_dir):
    failed = govern(wide_events(spark, sf_dir)).where(F.col("code").isNotNull())
    records = dlq_records(failed.withColumn("first_error", F.col("code")), F.col("ts"))
    return records.select("error", "timestamp", F.md5("raw").alias("digest"))


@query("dlq_read", _DLQ_SQL + """
SELECT code AS error, count(*) AS records, count(DISTINCT sha256(stamp || '|' || raw)) AS ids FROM dead GROUP BY code""")
def dlq_read(spark, sf_dir):
    """Lines written, read back and listed by error."""
    failed = govern(wide_events(spark, sf_dir)).where(F.col("code").isNotNull())
    records = dlq_records(failed.withColumn("first_error", F.col("code")), F.col("ts"))
    rows = dlq_rows(records.select(F.to_json(F.struct("timestamp", "error", "raw")).alias("value")))
    return rows.groupBy("error").agg(F.count("*").alias("records"), F.countDistinct("dlq_id").alias("ids"))


@query("dlq_damaged", _DLQ_SQL + """
SELECT CASE WHEN starts_with(md5(stamp), '0') THEN 'dlq_record_invalid_json' ELSE code END AS error, count(*) AS records
FROM dead GROUP BY 1""")
def dlq_damaged(spark, sf_dir):
    """Damaged lines become records of their own."""
    rows = dlq_rows(dead_lines(spark, sf_dir))
    return rows.groupBy("error").agg(F.count("*").alias("records"))


@query("dlq_replay", f"""WITH {CODES_SQL}
SELECT count(*) FILTER (code IN ('attr_count_exceeded', 'attr_depth_exceeded', 'string_too_long')) AS accepted,
  count(*) AS replayed FROM codes WHERE code IS NOT NULL""")
def replay(spark, sf_dir):
    """All dead letters through governance again, with the limits off."""
    failed = govern(wide_events(spark, sf_dir)).where(F.col("code").isNotNull())
    records = dlq_records(failed.withColumn("first_error", F.col("code")), F.col("ts"))
    rows = dlq_rows(records.select(F.to_json(F.struct("timestamp", "error", "raw")).alias("value")))
    return replay_counts(dlq_replay(rows, Settings(limits=Limits(enabled=False))))


def _dead_rows(spark, sf_dir) -> DataFrame:
    """Dead letters as rows, each taken apart once, for readers that go over them more than once."""
    failed = govern(wide_events(spark, sf_dir)).where(F.col("code").isNotNull())
    records = dlq_records(failed.withColumn("first_error", F.col("code")), F.col("ts"))
    return staged(dlq_rows(records.select(F.to_json(F.struct("timestamp", "error", "raw")).alias("value"))), "dead")


@query("dlq_delete", _DLQ_SQL + """
SELECT code AS error, count(*) AS records FROM dead WHERE code <> 'string_too_long' GROUP BY code""")
def dlq_delete(spark, sf_dir):
    """Dead letters without those of one error, removed by id."""
    rows = _dead_rows(spark, sf_dir)
    wanted = rows.where(F.col("error") == "string_too_long").select("dlq_id")
    return dlq_without(rows, wanted).groupBy("error").agg(F.count("*").alias("records"))


@query("dlq_show", _DLQ_SQL + """, wanted AS (SELECT min(sha256(stamp || '|' || raw)) AS id FROM dead)
SELECT code AS error, stamp AS timestamp, md5(raw) AS digest FROM dead, wanted WHERE sha256(stamp || '|' || raw) = id""")
def show(spark, sf_dir):
    """One record by its id: the smallest there is."""
    rows = _dead_rows(spark, sf_dir)
    wanted = rows.agg(F.min("dlq_id")).first()[0]
    return dlq_show(rows, wanted).select("error", "timestamp", F.md5("raw").alias("digest"))


@query("backlog_replay", f"""WITH {WIDE_SQL}
SELECT 'event' AS kind, count(*) AS lines, CAST(sum(strlen(raw)) AS BIGINT) AS bytes FROM wide WHERE json_valid(raw)
UNION ALL SELECT 'invalid_spool_record', count(*), CAST(sum(strlen(raw)) AS BIGINT) FROM wide WHERE NOT json_valid(raw)""")
def backlog_replay(spark, sf_dir):
    """A backlog of raw lines split into events and bad lines."""
    good, bad = split_backlog(wide_events(spark, sf_dir).select(F.concat("raw", F.lit(" \r")).alias("value")))
    sums = [F.count("*").alias("lines"), F.sum(F.octet_length("raw")).alias("bytes")]
    return good.groupBy(F.lit("event").alias("kind")).agg(*sums).unionByName(
        bad.groupBy(F.col("reason").alias("kind")).agg(*sums))


@query("strict_json", f"""WITH {WIDE_SQL}
SELECT json_valid(raw) AS valid, count(*) AS texts FROM wide GROUP BY 1""")
def strict(spark, sf_dir):
    """Whole-text JSON check: no text may follow the value."""
    rows = wide_events(spark, sf_dir)
    both = rows.select("raw").withColumn("valid", strict_json(trim(F.col("raw"))).isNotNull())
    return both.groupBy("valid").agg(F.count("*").alias("texts"))
