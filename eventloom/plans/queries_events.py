"""Queries over single events: parsing, limits, rewriting, registry, redaction, projection, dedupe."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventloom.config import (
    DEFAULT_BLOCKLIST, DEFAULT_REGISTRY, DedupeRules, Identity, Limits, Privacy, SchemaRules, Settings,
)
from eventloom.functions import crypto, sensitive
from eventloom.functions.jsontext import field_count, max_depth, unquote
from eventloom.functions.paths import extract_tenant, string_at
from eventloom.operators import governance as gov
from eventloom.operators import projection as proj
from eventloom.operators import redaction as red
from eventloom.operators import registry as reg
from eventloom.operators.dedupe import dedupe_window
from eventloom.operators.nodes import is_text, json_nodes
from eventloom.plans.catalog import query
from eventloom.plans.pipeline import process_events, run_batch
from eventloom.plans.wide_events import CODES_SQL, NODES_SQL, OBJECTS_SQL, WIDE_SQL, read_table, wide_events
from eventloom.session import staged

ROW = ("eid", "copy")

# What the collector step hides, as SQL over a node: its key in normal form, or a secret text.
_NORMAL = "replace(replace(lower(trim({key})), '-', '_'), '.', '_')"
_BLOCKED = "(" + ", ".join(f"'{n.replace('-', '_')}'" for n in DEFAULT_BLOCKLIST) + ")"
_SECRET_SQL = r"'(?i)(bearer\s+[a-z0-9._~+/=-]{12,}|sk-[a-z0-9]{16,}|-----BEGIN [A-Z ]*PRIVATE KEY-----)'"

_HIDDEN_CTES = f""",
texts AS (
  SELECT eid, copy, fullkey, path, key, type, value ->> '$' AS text,
         key IS NOT NULL AND {_NORMAL.format(key='key')} IN {_BLOCKED} AS blocked,
         key IS NOT NULL AND type = 'VARCHAR' AND regexp_matches(value ->> '$', {_SECRET_SQL}) AS secret
  FROM nodes
), hidden AS (SELECT * FROM texts WHERE blocked OR secret)"""
_HIDDEN_SQL = NODES_SQL + _HIDDEN_CTES + """,
covered AS (
  SELECT DISTINCT t.eid, t.copy, t.fullkey FROM texts t JOIN hidden h
  ON t.eid = h.eid AND t.copy = h.copy AND (starts_with(t.fullkey, h.fullkey || '.') OR starts_with(t.fullkey, h.fullkey || '['))
)"""


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are JSON objects, with ``doc``."""
    return gov.parse_events(wide_events(spark, sf_dir)).where(F.col("doc").isNotNull())


def governed(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    return gov.govern(wide_events(spark, sf_dir), settings)


@query("service_health", f"""WITH {CODES_SQL}
SELECT raw ->> '$.service' AS service, date_trunc('hour', ts) AS hour, count(*) AS events,
       CAST(sum(CASE WHEN CAST(raw ->> '$.http.status' AS INTEGER) >= 500 THEN 1 ELSE 0 END) AS BIGINT) AS errors,
       round(sum(CASE WHEN CAST(raw ->> '$.http.status' AS INTEGER) >= 500 THEN 1 ELSE 0 END) / count(*), 6) AS error_rate,
       round(avg(CAST(raw ->> '$.duration_ms' AS DOUBLE)), 6) AS mean_ms
FROM codes WHERE code IS NULL GROUP BY 1, 2""")
def service_health(spark, sf_dir):
    """Accepted events, error rate and mean duration per service and hour."""
    rows = governed(spark, sf_dir)
    passed = rows.withColumn("doc", F.when(F.col("code").isNull(), F.col("doc"))).where(F.col("code").isNull())
    typed = proj.typed_projection(passed, raw_column=None, keep=("ts",))
    errors = F.count_if(F.col("status_code") >= 500)
    return typed.groupBy("service", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.count("*").alias("events"), errors.alias("errors"),
        F.round(errors / F.count("*"), 6).alias("error_rate"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"))


@query("object_check", f"""WITH {OBJECTS_SQL}
SELECT w.eid, w.copy, o.eid IS NOT NULL AS is_object
FROM wide w LEFT JOIN objects o ON w.eid = o.eid AND w.copy = o.copy""")
def object_check(spark, sf_dir):
    return gov.parse_events(wide_events(spark, sf_dir)).select(*ROW, gov.is_json_object(F.col("raw"), F.col("doc")).alias("is_object"))


@query("string_extract", f"""WITH {OBJECTS_SQL}
SELECT eid, copy,
  CASE WHEN json_type(raw, '$.event_id') = 'VARCHAR' THEN raw ->> '$.event_id' END AS event_id,
  CASE WHEN json_type(raw, '$.user.id') = 'VARCHAR' THEN raw ->> '$.user.id' END AS user_id,
  CASE WHEN json_type(raw, '$.duration_ms') = 'VARCHAR' THEN raw ->> '$.duration_ms' END AS duration
FROM objects""")
def string_extract(spark, sf_dir):
    """Only JSON strings count: a numeric event_id or duration gives nothing."""
    doc = F.col("doc")
    return objects(spark, sf_dir).select(
        *ROW, string_at(doc, "event_id").alias("event_id"), string_at(doc, "user.id").alias("user_id"),
        string_at(doc, "duration_ms").alias("duration"))


@query("contract_check", f"""WITH {OBJECTS_SQL}
SELECT eid, copy, CASE WHEN raw ->> '$.schema_version' <> 'v1' THEN 'unsupported_schema_version' END AS code
FROM objects""")
def contract_check(spark, sf_dir):
    return objects(spark, sf_dir).select(
        *ROW, gov.contract_code(F.col("doc"), Settings().contract).alias("code"))


@query("json_nodes", f"""WITH {NODES_SQL}
SELECT path, depth, count(*) AS nodes, count(key) AS members FROM nodes GROUP BY path, depth""")
def nodes_by_path(spark, sf_dir):
    """Every node of every event: how often each path occurs."""
    nodes = json_nodes(objects(spark, sf_dir), keep=ROW)
    return nodes.groupBy("path", F.col("depth").cast("bigint").alias("depth")).agg(
        F.count("*").alias("nodes"), F.count("key").alias("members"))


@query("event_measures", f"""WITH {NODES_SQL}
SELECT eid, copy, count(key) AS n_fields, max(depth) AS depth FROM nodes GROUP BY eid, copy""")
def event_measures(spark, sf_dir):
    """Exact field count and depth of every event, without the cheap bounds."""
    rows = objects(spark, sf_dir).withColumn("text", F.to_json("doc"))
    return rows.select(*ROW, field_count(F.col("text")).cast("bigint").alias("n_fields"),
                       max_depth(F.col("text")).cast("bigint").alias("depth"))


@query("field_limits", f"""WITH {CODES_SQL}
SELECT eid, copy, code, message FROM codes WHERE code IS NOT NULL
AND code NOT IN ('expected_json_object', 'unsupported_schema_version')""")
def field_limits(spark, sf_dir):
    limited = gov.apply_limits(objects(spark, sf_dir), Limits())
    failed = F.col("code").isNotNull()
    # The contract check comes before the limits; its events are not looked at again.
    return limited.where(failed & gov.contract_code(F.col("doc"), Settings().contract).isNull()).select(
        *ROW, "code", "message")


@query("governance_codes", f"WITH {CODES_SQL} SELECT eid, copy, code, message FROM codes")
def governance_codes(spark, sf_dir):
    return governed(spark, sf_dir).select(*ROW, "code", "message")


# Events that only their size or nesting is wrong with, by the last two digits of their number.
_EDGE_SQL = """SELECT event_id AS eid, CASE event_id % 100
  WHEN 0 THEN 'event_too_large' WHEN 1 THEN 'attr_depth_exceeded' WHEN 2 THEN 'attr_depth_exceeded' WHEN 3 THEN 'attr_count_exceeded'
  WHEN 4 THEN 'expected_json_object' WHEN 5 THEN 'expected_json_object' WHEN 7 THEN 'event_too_large' END AS code,
CASE event_id % 100
  WHEN 0 THEN 'event exceeds max_event_bytes (300013 > 262144)'
  WHEN 1 THEN 'event depth exceeds max_attr_depth (1002 > 16)'
  WHEN 2 THEN 'event depth exceeds max_attr_depth (' || (17 + event_id % 900) || ' > 16)'
  WHEN 3 THEN 'event field count exceeds max_attr_count (1300 > 512)'
  WHEN 4 THEN 'event payload must be a JSON object' WHEN 5 THEN 'event payload must be a JSON object'
  WHEN 7 THEN 'event exceeds max_event_bytes (270000 > 262144)' END AS message
FROM events WHERE event_id % 100 < 8"""


@query("size_and_depth_codes", _EDGE_SQL)
def size_and_depth_codes(spark, sf_dir):
    """Codes of events over the size limit and beyond the nesting that can be parsed, valid and broken ones."""
    def nested(levels: Column, inside: str = "1") -> Column:
        return F.concat(F.lit('{"d":'), F.repeat(F.lit("["), levels), F.lit(inside), F.repeat(F.lit("]"), levels), F.lit("}"))

    eid, kind = F.col("event_id"), F.pmod("event_id", F.lit(100))
    text = (
        F.when(kind == 0, F.concat(F.lit('{"big":["'), F.repeat(F.lit("x"), 300_001), F.lit('"]}')))
        .when(kind == 1, nested(F.lit(1000)))
        .when(kind == 2, nested((15 + F.pmod(eid, F.lit(900))).cast("int")))
        .when(kind == 3, F.concat(F.repeat(F.lit('{"d":'), 1300), F.lit("1"), F.repeat(F.lit("}"), 1300)))
        # A bracket of the wrong kind, and one too many.
        .when(kind == 4, nested(F.lit(1200), "[1}"))
        .when(kind == 5, F.concat(nested(F.lit(1200)), F.lit("}")))
        .when(kind == 6, nested(F.lit(14)))
        .otherwise(nested(F.lit(1001), '"' + "y" * 267_990 + '"'))
    )
    rows = read_table(spark, sf_dir, "events").where(kind < 8).select(eid.alias("eid"), text.alias("raw"))
    return gov.govern(rows).select("eid", "code", "message")


@query("alias_normalize", f"""WITH {CODES_SQL}
SELECT eid, copy, coalesce(raw ->> '$.event', raw ->> '$.event_type') AS event, false AS has_alias
FROM codes WHERE code IS NULL""")
def alias_normalize(spark, sf_dir):
    rows = governed(spark, sf_dir).where(F.col("code").isNull())
    return rows.select(*ROW, F.try_variant_get("doc", "$.event", "string").alias("event"),
                       F.try_variant_get("doc", "$.event_type", "variant").isNotNull().alias("has_alias"))


@query("untouched_bytes", f"""WITH {CODES_SQL}{_HIDDEN_CTES}
SELECT eid, copy, md5(raw) AS digest FROM codes ANTI JOIN hidden USING (eid, copy)
WHERE code IS NULL AND NOT json_exists(raw, '$.event_type')""")
def untouched_bytes(spark, sf_dir):
    """Events that no step changes keep every byte."""
    before = wide_events(spark, sf_dir).withColumn("was", F.col("raw"))
    after = gov.govern(before).where(F.col("code").isNull() & (F.col("raw") == F.col("was")))
    return after.select(*ROW, F.md5("raw").alias("digest"))


_BOUND = Identity(allow_payload_identity=False, service_name="edge", service_version="2.1", environment="prod",
                  region="eu", tenant_id="acme", workspace_id="w1", organization_id="o1")


@query("identity_stamp", f"""WITH {CODES_SQL}
SELECT eid, copy, 'edge' AS service, 'edge' AS identity_name, '2.1' AS identity_version, 'prod' AS environment,
       'eu' AS region, 'acme' AS tenant, 'w1' AS workspace, 'o1' AS organization, raw ->> '$.user.id' AS user_id
FROM codes WHERE code IS NULL""")
def identity_stamp(spark, sf_dir):
    rows = governed(spark, sf_dir, Settings(identity=_BOUND)).where(F.col("code").isNull())
    paths = {"service": "service", "identity_name": "service_identity.name",
             "identity_version": "service_identity.version", "environment": "deployment.environment",
             "region": "deployment.region", "tenant": "tenant.id", "workspace": "workspace.id",
             "organization": "organization.id", "user_id": "user.id"}
    return proj.project_values(rows, paths, keep=ROW)


@query("tenant_extract", f"""WITH {OBJECTS_SQL}
SELECT raw ->> '$.tenant.id' AS tenant, count(*) AS events FROM objects GROUP BY 1""")
def tenant_extract(spark, sf_dir):
    rows = objects(spark, sf_dir)
    return rows.groupBy(extract_tenant(F.col("doc")).alias("tenant")).agg(F.count("*").alias("events"))


# --- registry ---------------------------------------------------------------------------------

_REQUIRED_SQL = """
checked AS (
  SELECT eid, copy, raw, coalesce(nullif(raw ->> '$.schema_version', ''), 'v1') AS sv,
    CASE WHEN coalesce(nullif(raw ->> '$.schema_version', ''), 'v1') <> 'v1' THEN NULL
         WHEN NOT json_exists(raw, '$.event_id') THEN 'event_id'
         WHEN NOT json_exists(raw, '$.event') THEN 'event'
         WHEN NOT json_exists(raw, '$.timestamp') THEN 'timestamp' END AS missing
  FROM objects
), errors AS (
  SELECT eid, copy, raw, missing, sv,
    CASE WHEN missing IS NOT NULL THEN 'schema validation: missing required field "' || missing || '"'
         WHEN sv <> 'v1' THEN 'schema validation: unknown schema/event version combination (' || sv || '/v1)'
    END AS error
  FROM checked
)"""


def _checked(spark, sf_dir, mode):
    registry = reg.registry_table(spark, DEFAULT_REGISTRY)
    return reg.check_schema(objects(spark, sf_dir), registry, SchemaRules(mode=mode))


@query("required_fields", f"WITH {OBJECTS_SQL}, {_REQUIRED_SQL} SELECT eid, copy, error FROM errors")
def required_fields(spark, sf_dir):
    return _checked(spark, sf_dir, "reject").select(*ROW, F.col("schema_error").alias("error"))


@query("schema_modes", f"""WITH {OBJECTS_SQL}, {_REQUIRED_SQL}
SELECT mode, CASE WHEN mode = 'off' THEN 'pass'
    WHEN mode = 'warn' THEN CASE WHEN missing IS NULL THEN 'pass' ELSE 'warn' END
    WHEN error IS NULL THEN 'pass' WHEN mode = 'quarantine' THEN 'quarantine' ELSE 'invalid' END AS route,
  count(*) AS events
FROM errors, (VALUES ('off'), ('warn'), ('reject'), ('enforce'), ('quarantine')) m(mode) GROUP BY 1, 2""")
def schema_modes(spark, sf_dir):
    parts = [
        _checked(spark, sf_dir, mode).groupBy(F.lit(mode).alias("mode"), F.col("schema_route").alias("route"))
        .agg(F.count("*").alias("events"))
        for mode in ("off", "warn", "reject", "enforce", "quarantine")
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("version_defaults", f"""WITH {OBJECTS_SQL}
SELECT eid, copy, coalesce(raw ->> '$.schema_version', 'v1') AS schema_version, 'v1' AS event_version,
       raw ->> '$.event_id' AS event_id FROM objects""")
def version_defaults(spark, sf_dir):
    rows = reg.apply_version_defaults(objects(spark, sf_dir), SchemaRules())
    again = rows.withColumn("doc", F.try_parse_json("raw"))
    return proj.project_values(again, {n: n for n in ("schema_version", "event_version", "event_id")}, keep=ROW)


@query("quarantine", f"""WITH {OBJECTS_SQL}, {_REQUIRED_SQL}
SELECT error, count(*) AS events, CAST(sum(strlen(raw)) AS BIGINT) AS bytes FROM errors WHERE error IS NOT NULL GROUP BY 1""")
def quarantine(spark, sf_dir):
    held = reg.quarantine_records(_checked(spark, sf_dir, "quarantine"))
    return held.groupBy("error").agg(F.count("*").alias("events"), F.sum(F.octet_length("raw")).alias("bytes"))


def observed_registry(spark, sf_dir, half: int) -> DataFrame:
    """A registry as seen in the data: per service and event, the keys that occur in half of the days."""
    rows = objects(spark, sf_dir).where(F.pmod(F.dayofmonth("ts"), F.lit(2)) == half)
    service, event = string_at(F.col("doc"), "service"), string_at(F.col("doc"), "event")
    keys = rows.select(service.alias("schema_version"), event.alias("event_version"),
                       F.explode(F.json_object_keys("raw")).alias("name"))
    wanted = keys.where(F.col("event_version").isNotNull())
    pairs = wanted.distinct()
    return pairs.groupBy("schema_version", "event_version").agg(
        F.array_sort(F.collect_list("name")).alias("required_fields"))


_OBSERVED_SQL = OBJECTS_SQL + """,
pairs AS (
  SELECT DISTINCT raw ->> '$.service' AS sv, raw ->> '$.event' AS ev, dayofmonth(ts) % 2 AS half,
         unnest(json_keys(raw)) AS name
  FROM objects WHERE json_exists(raw, '$.event')
), observed AS (
  SELECT sv, ev, half, list(name ORDER BY name) AS names FROM pairs GROUP BY ALL
), cur AS (SELECT * FROM observed WHERE half = 0 AND ev NOT IN ('signup') AND sv <> 'svc_4'),
new AS (SELECT * FROM observed WHERE half = 1 AND ev NOT IN ('view'))"""


def _registries(spark, sf_dir):
    current = observed_registry(spark, sf_dir, 0).where("event_version <> 'signup' AND schema_version <> 'svc_4'")
    proposed = observed_registry(spark, sf_dir, 1).where("event_version <> 'view'")
    # As sent by a client: unsorted, repeated and padded names.
    messy = F.concat(F.reverse("required_fields"), F.transform("required_fields", lambda n: F.concat(F.lit(" "), n)),
                     F.array(F.lit("  ")))
    return current, proposed.withColumn("required_fields", messy)


@query("schema_diff", f"""WITH {_OBSERVED_SQL}
SELECT coalesce(c.sv, n.sv) AS schema_version, coalesce(c.ev, n.ev) AS event_version,
  array_to_string(list_sort(list_filter(coalesce(n.names, []), lambda x: NOT list_contains(coalesce(c.names, []), x))), ',') AS added,
  array_to_string(list_sort(list_filter(coalesce(c.names, []), lambda x: NOT list_contains(coalesce(n.names, []), x))), ',') AS removed,
  array_to_string(list_sort(list_filter(coalesce(n.names, []), lambda x: list_contains(coalesce(c.names, []), x))), ',') AS unchanged
FROM cur c FULL JOIN new n ON c.sv = n.sv AND c.ev = n.ev""")
def schema_diff(spark, sf_dir):
    diff = reg.schema_diff(*_registries(spark, sf_dir))
    return diff.select("schema_version", "event_version",
                       *(F.array_join(F.array_sort(c), ",").alias(c) for c in ("added", "removed", "unchanged")))


@query("schema_publish", f"""WITH {_OBSERVED_SQL}
SELECT sv AS schema_version, ev AS event_version, array_to_string(names, ',') AS required_fields FROM new
UNION ALL
SELECT sv, ev, array_to_string(names, ',') FROM cur
WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.sv = cur.sv AND new.ev = cur.ev)""")
def schema_publish(spark, sf_dir):
    current, proposed = _registries(spark, sf_dir)
    published = reg.schema_publish(current, proposed)
    return published.withColumn("required_fields", F.array_join("required_fields", ","))


# --- redaction --------------------------------------------------------------------------------

@query("redact_block", f"""WITH {_HIDDEN_SQL}
SELECT t.eid, t.copy, t.path, CASE WHEN t.blocked OR t.secret THEN '[REDACTED]' ELSE t.text END AS text
FROM texts t ANTI JOIN covered c ON t.eid = c.eid AND t.copy = c.copy AND t.fullkey = c.fullkey
WHERE t.blocked OR t.secret OR t.type = 'VARCHAR'""")
def redact_block(spark, sf_dir):
    """All text leaves after the collector step, on every object."""
    rows = gov.redact_events(wide_events(spark, sf_dir), Privacy(), Limits(enabled=False))
    redacted = staged(rows.where(F.col("doc").isNotNull()).select(*ROW, "raw"), "redacted")
    leaves = json_nodes(redacted, keep=ROW)
    return leaves.where(is_text(F.col("value"))).select(*ROW, "path", unquote(F.col("value")).alias("text"))


@query("secret_scan", f"""WITH {NODES_SQL}
SELECT path, count(*) AS hits FROM nodes
WHERE type = 'VARCHAR' AND regexp_matches(value ->> '$', {_SECRET_SQL}) GROUP BY path""")
def secret_scan(spark, sf_dir):
    """Strings with a secret, in members and in arrays alike."""
    marked = objects(spark, sf_dir).where(sensitive.secret_match(F.col("raw")) | F.contains("raw", F.lit("\\")))
    texts = json_nodes(marked, keep=ROW).where(is_text(F.col("value")))
    hits = texts.where(sensitive.secret_match(unquote(F.col("value"))))
    return hits.groupBy("path").agg(F.count("*").alias("hits"))


_ALLOW = ("event_id", "event", "service", "user", "user.id", "timestamp", "items", "items.n", "http.*", "http")


@query("redact_allow", f"""WITH {OBJECTS_SQL}
SELECT eid, copy,
  CASE WHEN json_exists(raw, '$.event_id') THEN raw ->> '$.event_id' END AS event_id,
  raw ->> '$.user.id' AS user_id, raw ->> '$.http.status' AS status,
  '[REDACTED]' AS tenant, '[REDACTED]' AS props,
  raw ->> '$.items[0].n' AS item_n,
  CASE WHEN json_exists(raw, '$.items') THEN '[REDACTED]' END AS item_token,
  CASE WHEN json_exists(raw, '$.password') THEN '[REDACTED]' END AS password
FROM objects""")
def redact_allow(spark, sf_dir):
    rows = red.redact_processor(objects(spark, sf_dir), Privacy(allowlist=_ALLOW))
    paths = {"event_id": "event_id", "user_id": "user.id", "status": "http.status", "tenant": "tenant",
             "props": "props", "item_n": "items[0].n", "item_token": "items[0].token", "password": "password"}
    return proj.project_values(rows, paths, keep=ROW)


_EXACT_KEEP = ("event_id", "amount", "deep", "k", "list", "list.n")
_NESTED = 70


@query("redact_exact", f"""SELECT event_id AS eid,
  ' {{ "event_id" : "evt_' || event_id || '", "amount":0.' || (1234567890123456789 - event_id) || ' ,"deep":' ||
  repeat('{{"k": [', {_NESTED}) || '{{"k":' || event_id || ',"secret":"[REDACTED]"}}' || repeat(']}}', {_NESTED}) ||
  ',"user":"[REDACTED]", "list" : [ {{"n":1e2 , "m":"[REDACTED]"}} , 7] }}' AS raw
FROM events""")
def redact_exact(spark, sf_dir):
    """Masks are spliced into the text: spaces, long decimals and 140 levels of nesting come out as they went in."""
    eid = F.col("event_id")
    text = F.concat(
        F.lit(' { "event_id" : "evt_'), eid, F.lit('", "amount":0.'), F.lit(1234567890123456789) - eid, F.lit(' ,"deep":'),
        F.repeat(F.lit('{"k": ['), _NESTED), F.lit('{"k":'), eid, F.lit(',"secret":{"a":[1,"]"]}}'), F.repeat(F.lit("]}"), _NESTED),
        F.lit(',"user":{"id":[{}],"n":"}"}, "list" : [ {"n":1e2 , "m":null} , 7] }'))
    rows = read_table(spark, sf_dir, "events").select(eid.alias("eid"), text.alias("raw"))
    parsed = rows.withColumn("doc", F.try_parse_json("raw"))
    return red.redact_processor(parsed, Privacy(allowlist=_EXACT_KEEP)).select("eid", "raw")


@query("privacy_modes", f"""WITH {CODES_SQL}
SELECT mode, eid, copy, CASE WHEN code <> 'expected_json_object' THEN code
  WHEN code IS NOT NULL AND mode = 'enforce' THEN 'privacy_redaction_failed' END AS code,
  code IS NULL AND json_exists(CASE WHEN code = 'expected_json_object' THEN '{{}}' ELSE raw END, '$.note') AS has_note
FROM codes, (VALUES ('warn'), ('enforce')) modes(mode)""")
def privacy_modes(spark, sf_dir):
    """Events that cannot be redacted: kept as they are with a warning, or refused."""
    registry = reg.registry_table(spark, DEFAULT_REGISTRY)

    def run(mode: str) -> DataFrame:
        settings = Settings(validate_objects=False, privacy=Privacy(mode=mode))
        rows = process_events(wide_events(spark, sf_dir), settings, registry)
        masked = F.try_variant_get("doc", "$.note", "string") == sensitive.MASK
        return rows.select(F.lit(mode).alias("mode"), *ROW, "code", F.coalesce(masked, F.lit(False)).alias("has_note"))

    return run("warn").unionByName(run("enforce"))


_PLACES = ("user.*", "items.token", "auth.api-key", "TENANT")


@query("redact_paths", f"""WITH {OBJECTS_SQL}
SELECT eid, copy, '[REDACTED]' AS user_id, '[REDACTED]' AS tenant, raw ->> '$.service' AS service,
  CASE WHEN json_exists(raw, '$.items') THEN '[REDACTED]' END AS item_token,
  CASE WHEN json_exists(raw, '$.auth') THEN '[REDACTED]' END AS api_key,
  raw ->> '$.auth.user' AS auth_user, raw ->> '$.password' AS password
FROM objects""")
def redact_paths(spark, sf_dir):
    rows = red.redact_processor(objects(spark, sf_dir), Privacy(blocklist=_PLACES))
    paths = {"user_id": "user.id", "tenant": "tenant", "service": "service", "item_token": "items[0].token",
             "api_key": "auth.api-key", "auth_user": "auth.user", "password": "password"}
    return proj.project_values(rows, paths, keep=ROW)


@query("redact_names", f"""WITH {OBJECTS_SQL}
SELECT eid, copy, CASE WHEN json_exists(raw, '$.password') THEN '[REDACTED]' END AS password,
  '[REDACTED]' AS tenant, raw ->> '$.auth.api-key' AS api_key,
  CASE WHEN json_exists(raw, '$.items') THEN '[REDACTED]' END AS inner_value, raw ->> '$.user.id' AS user_id
FROM objects""")
def redact_names(spark, sf_dir):
    """Plain names only: the whole step stays in the JVM.  ``cookie`` is the last part of ``Set.Cookie``."""
    rows = red.redact_processor(objects(spark, sf_dir), Privacy(blocklist=("PASSWORD", "tenant", "api_key", "cookie")))
    doc = F.col("doc")
    return rows.select(
        *ROW, F.try_variant_get(doc, "$.password", "string").alias("password"),
        F.try_variant_get(doc, "$.tenant", "string").alias("tenant"),
        F.try_variant_get(doc, "$.auth['api-key']", "string").alias("api_key"),
        F.try_variant_get(doc, "$.items[2].inner['Set.Cookie']", "string").alias("inner_value"),
        F.try_variant_get(doc, "$.user.id", "string").alias("user_id"))


@query("redaction_audit", f"""WITH {NODES_SQL},
found AS (
  SELECT eid, copy, regexp_replace(path, '\\[\\d+\\]', '', 'g') AS field, key FROM nodes
  WHERE key IS NOT NULL AND (lower(key) IN ('password', 'token', 'auth') OR lower(path) IN ('password', 'token', 'auth'))
)
SELECT field, 'pii_redacted' AS message, count(*) AS events FROM found GROUP BY 1, 2""")
def redaction_audit(spark, sf_dir):
    audit = red.redaction_audit(objects(spark, sf_dir), Privacy(blocklist=("password", "token", "auth")), ROW)
    return audit.groupBy("field", "message").agg(F.count("*").alias("events"))


@query("pii_audit", f"""WITH {NODES_SQL},
found AS (
  SELECT path, 'restricted' AS classification FROM nodes
  WHERE key IS NOT NULL AND {_NORMAL.format(key='key')} IN {_BLOCKED}
  UNION ALL
  SELECT path, 'confidential' FROM nodes
  WHERE key IS NOT NULL AND type = 'VARCHAR' AND regexp_matches(value ->> '$', {_SECRET_SQL})
)
SELECT path, classification, count(*) AS count FROM found GROUP BY 1, 2""")
def pii_audit(spark, sf_dir):
    return red.pii_audit(wide_events(spark, sf_dir), DEFAULT_BLOCKLIST, keep=ROW)


_TOKEN_TEXT = r"(?i)(token\s*=\s*\"[^\"]+\"|bearer\s+[a-z0-9._~+/=-]{12,}|sk-[a-z0-9]{16,}|-----BEGIN [A-Z ]*PRIVATE KEY-----)"


@query("text_pii_audit", f"""WITH texts AS (
  SELECT 'document.text' AS path, text FROM documents UNION ALL
  SELECT 'page.html', html FROM pages UNION ALL SELECT 'turn.text', text FROM conversations)
SELECT path, 'confidential' AS classification, count(*) AS count FROM texts
WHERE regexp_matches(text, '{_TOKEN_TEXT}') GROUP BY path""")
def text_pii_audit(spark, sf_dir):
    """Whole documents, pages and conversation turns, wrapped as events and audited for secrets."""

    def wrapped(table: str, key: str, outer: str, text: str) -> DataFrame:
        body = F.struct(F.struct(F.col(key).alias("id"), F.col(text).alias(text)).alias(outer))
        return read_table(spark, sf_dir, table).select(F.to_json(body).alias("raw"))

    rows = wrapped("documents", "doc_id", "document", "text").union(
        wrapped("pages", "page_id", "page", "html")).union(wrapped("conversations", "conv_id", "turn", "text"))
    return red.pii_audit(rows, DEFAULT_BLOCKLIST, secret=_TOKEN_TEXT)


# --- projection -------------------------------------------------------------------------------

@query("typed_projection", f"""WITH {OBJECTS_SQL}
SELECT eid, copy, raw ->> '$.event_id' AS event_id, raw ->> '$.event' AS event_type, raw ->> '$.service' AS service,
  CAST(raw ->> '$.http.status' AS INTEGER) AS status_code, CAST(raw ->> '$.duration_ms' AS DOUBLE) AS duration_ms,
  CAST(replace(raw ->> '$.timestamp', 'Z', '') AS TIMESTAMP) AS timestamp, md5(raw) AS digest,
  CAST(NULL AS VARCHAR) AS cast_error
FROM objects""")
def typed_projection(spark, sf_dir):
    typed = proj.typed_projection(objects(spark, sf_dir), keep=ROW)
    return typed.withColumn("digest", F.md5("raw")).withColumn(
        "timestamp", F.col("timestamp").cast("timestamp_ntz")).drop("raw")


@query("cast_failures", f"""WITH {OBJECTS_SQL}
SELECT eid, copy, CASE WHEN TRY_CAST(raw ->> '$.user.id' AS INTEGER) IS NULL THEN 'cast_failed:user_number' END AS cast_error,
  TRY_CAST(raw ->> '$.props.k' AS INTEGER) AS k
FROM objects""")
def cast_failures(spark, sf_dir):
    return proj.typed_projection(
        objects(spark, sf_dir), {"user_number": "user.id", "k": "props.k"},
        {"user.id": "INTEGER", "props.k": "INTEGER"}, raw_column=None, keep=ROW,
    ).drop("user_number")


@query("project_values", f"""WITH {OBJECTS_SQL}
SELECT eid, copy, raw ->> '$.items[0].token' AS first_token, raw ->> '$.items[2].inner."Set.Cookie"[1]' IS NOT NULL AS has_inner,
  raw ->> '$.http' AS http, raw ->> '$.nothing.here' AS nothing
FROM objects""")
def project_values(spark, sf_dir):
    paths = {"http": "http", "first_token": "items[0].token", "nothing": "nothing.here", "inner": "items[2].inner"}
    return proj.project_values(objects(spark, sf_dir), paths, keep=ROW).withColumn(
        "has_inner", F.col("inner").isNotNull()).drop("inner")


@query("project_encoded", f"""WITH {OBJECTS_SQL}
SELECT eid, copy, (CASE WHEN json_exists(raw, '$.event') THEN 'e,' ELSE '' END) ||
  (CASE WHEN json_exists(raw, '$.note') THEN 'n,' ELSE '' END) || 's' AS keys,
  raw ->> '$.note' AS n, CAST(raw ->> '$.http.status' AS INTEGER) AS s, true AS ends_line
FROM objects""")
def project_encoded(spark, sf_dir):
    """Absent paths are left out of the JSON text."""
    line = proj.project_encoded(F.col("doc"), {"s": "http.status", "e": "event", "n": "note"})
    rows = objects(spark, sf_dir).select(*ROW, line.alias("line"))
    again = F.try_parse_json("line")
    return rows.select(
        *ROW, F.array_join(F.json_object_keys("line"), ",").alias("keys"),
        F.try_variant_get(again, "$.n", "string").alias("n"), F.try_variant_get(again, "$.s", "int").alias("s"),
        F.endswith("line", F.lit("\n")).alias("ends_line"))


@query("canonical_event", f"""WITH {OBJECTS_SQL}
SELECT eid, copy, CASE WHEN json_type(raw, '$.event_id') = 'VARCHAR' THEN raw ->> '$.event_id' END AS event_id,
  raw ->> '$.event' AS event, raw ->> '$.service' AS service, 'info' AS level, 1 AS severity,
  CAST(raw ->> '$.http.status' AS INTEGER) AS status_code,
  CAST(trunc(CAST(raw ->> '$.duration_ms' AS DOUBLE)) AS BIGINT) AS duration_ms,
  CAST(replace(raw ->> '$.timestamp', 'Z', '') AS TIMESTAMP) AS timestamp, raw ->> '$.schema_version' AS schema_version
FROM objects""")
def canonical_event(spark, sf_dir):
    typed = proj.canonical_event(objects(spark, sf_dir), keep=ROW)
    return typed.select(
        *ROW, "event_id", "event", "service", "level", proj.level_ordinal(F.col("level")).cast("int").alias("severity"),
        "status_code", "duration_ms", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "schema_version")


@query("encrypt_roundtrip", f"""WITH {WIDE_SQL}
SELECT eid, copy, md5(raw) AS digest, true AS sealed, true AS hidden FROM wide""")
def encrypt_roundtrip(spark, sf_dir):
    rows = wide_events(spark, sf_dir).withColumn("sealed", crypto.encrypt_column(F.col("raw"), "passphrase"))
    opened = crypto.decrypt_column(F.col("sealed"), "passphrase")
    return rows.select(*ROW, F.md5(opened).alias("digest"),
                       F.col("sealed").rlike("^enc:[A-Za-z0-9+/=]+$").alias("sealed"),
                       (~F.contains("sealed", F.col("raw"))).alias("hidden"))


# --- dedupe -----------------------------------------------------------------------------------

def fold_sql(source: str, key: str, window: str) -> str:
    """The first-kept rule as a recursive walk over the rows of each key."""
    return f"""ranked AS MATERIALIZED (
  SELECT eid, copy, ts, {key} AS dk, row_number() OVER (PARTITION BY {key} ORDER BY ts, eid, copy) AS rn
  FROM {source} WHERE trim({key}) <> ''
), walk AS (
  SELECT eid, copy, dk, rn, ts AS kept, false AS duplicate FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.eid, r.copy, r.dk, r.rn, CASE WHEN r.ts - w.kept > {window} THEN r.ts ELSE w.kept END,
         r.ts - w.kept <= {window}
  FROM walk w JOIN ranked r ON r.dk = w.dk AND r.rn = w.rn + 1
)"""


_DEDUPE_SQL = "WITH RECURSIVE " + OBJECTS_SQL + """,
keyed AS (SELECT *, CASE WHEN json_type(raw, '$.event_id') = 'VARCHAR' THEN raw ->> '$.event_id' END AS event_id,
                 raw ->> '$.user.id' AS user_id FROM objects),
"""


def _keyed(spark, sf_dir):
    doc = F.col("doc")
    return objects(spark, sf_dir).select(
        *ROW, "ts", string_at(doc, "event_id").alias("event_id"), string_at(doc, "user.id").alias("user_id"))


@query("dedupe_window", _DEDUPE_SQL + fold_sql("keyed", "event_id", "INTERVAL 24 HOUR") + """
SELECT k.eid, k.copy, coalesce(w.duplicate, false) AS duplicate
FROM keyed k LEFT JOIN walk w ON k.eid = w.eid AND k.copy = w.copy""")
def dedupe_by_event(spark, sf_dir):
    rows = dedupe_window(_keyed(spark, sf_dir), "event_id", "ts", ROW, timedelta(hours=24))
    return rows.select(*ROW, "duplicate")


@query("dedupe_user", _DEDUPE_SQL + fold_sql("keyed", "user_id", "INTERVAL 6 HOUR") + """
SELECT k.eid, k.copy, coalesce(w.duplicate, false) AS duplicate
FROM keyed k LEFT JOIN walk w ON k.eid = w.eid AND k.copy = w.copy""")
def dedupe_by_user(spark, sf_dir):
    """Long chains: one event per user and six hours."""
    rows = dedupe_window(_keyed(spark, sf_dir), "user_id", "ts", ROW, timedelta(hours=6))
    return rows.select(*ROW, "duplicate")


@query("dedupe_hot", _DEDUPE_SQL + "tenants AS (SELECT *, raw ->> '$.tenant.id' AS tenant FROM objects),\n"
       + fold_sql("tenants", "tenant", "INTERVAL 72 HOUR") + """
SELECT eid, copy, duplicate FROM walk""")
def dedupe_hot(spark, sf_dir):
    """Three keys that hold everything, cut into chunks."""
    rows = objects(spark, sf_dir).select(*ROW, "ts", string_at(F.col("doc"), "tenant.id").alias("tenant"))
    judged = dedupe_window(rows, "tenant", "ts", ROW, timedelta(hours=72), chunk_times=100)
    return judged.select(*ROW, "duplicate")


@query("dedupe_minute", _DEDUPE_SQL
       + "mixed AS (SELECT *, CASE WHEN eid % 3 = 0 THEN 'hot' ELSE raw ->> '$.user.id' END AS k FROM objects),\n"
       + fold_sql("mixed", "k", "INTERVAL 1 MINUTE") + """
SELECT eid, copy, duplicate FROM walk""")
def dedupe_minute(spark, sf_dir):
    """A window of a minute, and one key that holds a third of all rows: as many windows as rows."""
    rows = objects(spark, sf_dir).select(*ROW, "ts", F.when(F.col("eid") % 3 == 0, "hot").otherwise(
        string_at(F.col("doc"), "user.id")).alias("k"))
    return dedupe_window(rows, "k", "ts", ROW, timedelta(minutes=1), chunk_times=200).select(*ROW, "duplicate")


@query("full_pipeline", "WITH RECURSIVE " + CODES_SQL + """,
judged AS (
  SELECT eid, copy, ts, code,
    CASE WHEN code IS NOT NULL THEN code WHEN NOT json_exists(raw, '$.event_id') OR NOT json_exists(raw, '$.timestamp')
         THEN 'schema_invalid' END AS final_code,
    CASE WHEN json_type(raw, '$.event_id') = 'VARCHAR' THEN raw ->> '$.event_id' END AS event_id
  FROM (SELECT * EXCLUDE (raw), CASE WHEN code = 'expected_json_object' THEN '{}' ELSE raw END AS raw FROM codes)
), keyed AS (SELECT * FROM judged WHERE final_code IS NULL),
""" + fold_sql("keyed", "event_id", "INTERVAL 24 HOUR") + """
SELECT j.eid, j.copy, CASE WHEN final_code IS NULL THEN 'accepted' ELSE 'invalid' END AS status,
  coalesce(final_code, CASE WHEN w.duplicate THEN 'duplicate_event_id' ELSE 'accepted' END) AS reason
FROM judged j LEFT JOIN walk w ON j.eid = w.eid AND j.copy = w.copy""")
def full_pipeline(spark, sf_dir):
    """Governance, registry, redaction, dedupe and acknowledgement of every event."""
    acked = run_batch(wide_events(spark, sf_dir), FULL_SETTINGS, reg.registry_table(spark, DEFAULT_REGISTRY),
                      "ts", ROW)
    return acked.select(*ROW, "status", "reason")


FULL_SETTINGS = Settings(schema=SchemaRules(mode="enforce"), dedupe=DedupeRules(enabled=True))
