"""Wide JSON events derived from the ``events`` table, in Spark and in SQL.

Every row becomes one event; ``event_id % 20`` selects a variation, so that each rule has events
that break it.  The two forms build the same text character by character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

VARIANTS = 20

# Rows of a table that one task reads: some 30 MB of wide events.
TASK_ROWS = 20_000
_BEARER = "Bearer abcdefghijklmnop"
_ITEMS = ('{"token":"t1","n":1},"' + _BEARER + '",{"inner":{"Set.Cookie":[1,2]}},{"memo":"a, \\"token\\": sk-'
          + "0" * 16 + '"}')


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _tasks(df: DataFrame) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def spread(df: DataFrame) -> DataFrame:
    """Dealt out by the number of rows, which the footers tell: a few bytes of a row may become kilobytes of text, so a split of
    the file may be far too much for one task.  Tasks keep their size as the table grows; a small table keeps all cores busy.
    """
    tasks = _tasks(df)
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def _text(*parts: object) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def wide_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(eid, copy, ts, raw)``; (eid, copy) identifies a row."""
    return widen(read_table(spark, sf_dir, "events"))


def wide_events_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``wide_events``, neighbours in time in one task: for writers of a folder an hour.

    The rows move before they are widened, and a task has no more of them than elsewhere, so sorting them needs no disk.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return widen(events.repartitionByRange(_tasks(events), "ts"))


def widen(events: DataFrame) -> DataFrame:
    eid, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    m, k = F.pmod(eid, F.lit(VARIANTS)), F.floor(eid / VARIANTS)
    copies = F.when(m == 12, F.array(F.lit(0), F.lit(20), F.lit(30))).otherwise(F.array(F.lit(0)))
    rows = events.select("*", F.posexplode(copies).alias("copy", "shift"))
    ts = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("shift") * F.lit(3_600_000_000))
    rows = rows.withColumn("ts", ts)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    no_id = F.when(k % 3 == 0, F.lit('"event_id":" ",')).when(k % 3 == 1, _text('"event_id":', eid, ",")).otherwise("")
    head = F.concat(
        F.lit("{"),
        F.when(m == 11, no_id).otherwise(_text('"event_id":"evt_', eid, '",')),
        F.when(m == 1, _text('"event_type":"', kind, '",'))
        .when(m == 14, _text('"event":"', kind, '","event_type":"old",')).otherwise(_text('"event":"', kind, '",')),
        F.when(m == 2, F.lit('"schema_version":"v9",')).otherwise(""),
        F.when(m == 3, F.lit("")).otherwise(_text('"timestamp":"', stamp, '",')),
        _text('"service":"svc_', F.pmod(user, F.lit(5)), '","duration_ms":', F.col("value")),
        F.when(kind == "error", F.lit(',"http":{"status":500}')).otherwise(',"http":{"status":200}'),
        _text(',"tenant":{"id":"t', F.pmod(user, F.lit(3)), '"},"user":{"id":"u-', user, '"},"props":', F.col("props")),
    )
    many = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(599)), lambda i: _text(',"x', i, '":', i)), "")
    tail = (
        F.when(m == 4, _text(',"password":"p-', eid, '","auth":{"api-key":"k","user":"u"}'))
        .when(m == 5, F.lit(f',"note":"{_BEARER}"'))
        .when(m == 6, F.lit(f',"items":[{_ITEMS}]'))
        .when(m == 7, many)
        .when(m == 8, _text(',"deep":', F.repeat(F.lit('{"d":'), 17), "1", F.repeat(F.lit("}"), 17)))
        .when(m == 9, _text(',"blob":"', F.when(k % 2 == 0, F.repeat(F.lit("x"), 16386))
                            .otherwise(F.repeat(F.lit("é"), 8193)), '"'))
        .when(m == 13, F.lit(',"\\u0070assword":"q"'))
        .when(m == 15, _text(',"context":{"user_id":"u-', user, '"}'))
        .otherwise("")
    )
    broken = F.when(k % 3 == 0, "[1]").when(k % 3 == 1, '"x"').otherwise("{bad")
    raw = F.when(m == 10, broken).otherwise(F.concat(head, tail, F.lit("}")))
    return rows.select(eid.alias("eid"), "copy", "ts", raw.alias("raw"))


# The same rows in DuckDB.
WIDE_SQL = f"""
copies AS (
  SELECT event_id AS eid, c AS copy, ts + INTERVAL (h) HOUR AS ts, user_id AS u, event_type AS kind, value, props,
         event_id % {VARIANTS} AS m, event_id // {VARIANTS} AS k
  FROM events, (VALUES (0, 0), (1, 20), (2, 30)) shifts(c, h)
  WHERE c = 0 OR event_id % {VARIANTS} = 12
),
many AS (SELECT string_agg(',"x' || i || '":' || i, '' ORDER BY i) AS keys FROM range(600) r(i)),
wide AS MATERIALIZED (
  SELECT eid, copy, ts,
    CASE WHEN m = 10 THEN CASE k % 3 WHEN 0 THEN '[1]' WHEN 1 THEN '"x"' ELSE '{{bad' END ELSE
      '{{' ||
      CASE WHEN m = 11 THEN CASE k % 3 WHEN 0 THEN '"event_id":" ",' WHEN 1 THEN '"event_id":' || eid || ',' ELSE '' END
           ELSE '"event_id":"evt_' || eid || '",' END ||
      CASE m WHEN 1 THEN '"event_type":"' || kind || '",' WHEN 14 THEN '"event":"' || kind || '","event_type":"old",'
             ELSE '"event":"' || kind || '",' END ||
      CASE WHEN m = 2 THEN '"schema_version":"v9",' ELSE '' END ||
      CASE WHEN m = 3 THEN '' ELSE '"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '",' END ||
      '"service":"svc_' || (u % 5) || '","duration_ms":' || value ||
      CASE WHEN kind = 'error' THEN ',"http":{{"status":500}}' ELSE ',"http":{{"status":200}}' END ||
      ',"tenant":{{"id":"t' || (u % 3) || '"}},"user":{{"id":"u-' || u || '"}},"props":' || props ||
      CASE m
        WHEN 4 THEN ',"password":"p-' || eid || '","auth":{{"api-key":"k","user":"u"}}'
        WHEN 5 THEN ',"note":"{_BEARER}"'
        WHEN 6 THEN ',"items":[{_ITEMS}]'
        WHEN 7 THEN (SELECT keys FROM many)
        WHEN 8 THEN ',"deep":' || repeat('{{"d":', 17) || '1' || repeat('}}', 17)
        WHEN 9 THEN ',"blob":"' || CASE k % 2 WHEN 0 THEN repeat('x', 16386) ELSE repeat('é', 8193) END || '"'
        WHEN 13 THEN ',"\\u0070assword":"q"'
        WHEN 15 THEN ',"context":{{"user_id":"u-' || u || '"}}'
        ELSE '' END || '}}'
    END AS raw
  FROM copies
)"""

# Documents among them, every node of a document, and the measures behind the limits.
OBJECTS_SQL = WIDE_SQL + """,
objects AS (SELECT * FROM wide WHERE json_valid(raw) AND json_type(raw) = 'OBJECT')"""

NODES_SQL = OBJECTS_SQL + """,
nodes AS MATERIALIZED (
  SELECT o.eid, o.copy, t.fullkey, t.type, t.value, t.atom,
         t.fullkey = '$' AS is_root, t.fullkey LIKE '%]' AS is_element,
         replace(regexp_replace(t.fullkey, '^\\$\\.?', ''), '"', '') AS path,
         length(regexp_replace(regexp_replace(t.fullkey, '"[^"]*"', 'q', 'g'), '[^.\\[]', '', 'g')) + 1 AS depth,
         CASE WHEN t.fullkey LIKE '%]' OR t.fullkey = '$' THEN NULL
              ELSE replace(regexp_extract(t.fullkey, '\\.("[^"]*"|[^.]*)$', 1), '"', '') END AS key
  FROM objects o, json_tree(o.raw) t
)"""

# First failing rule of governance per event; NULL for events that pass.
CODES_SQL = NODES_SQL + """,
measures AS (
  SELECT eid, copy, count(key) AS n_fields, max(depth) AS depth,
         min(CASE WHEN type = 'VARCHAR' AND strlen(value ->> '$') > 16384 THEN path END) AS long_path,
         max(CASE WHEN type = 'VARCHAR' AND strlen(value ->> '$') > 16384 THEN strlen(value ->> '$') END) AS long_bytes
  FROM nodes GROUP BY eid, copy
),
codes AS MATERIALIZED (
  SELECT w.eid, w.copy, w.ts, w.raw,
    CASE WHEN x.eid IS NULL THEN 'expected_json_object'
         WHEN w.raw ->> '$.schema_version' <> 'v1' THEN 'unsupported_schema_version'
         WHEN strlen(w.raw) > 262144 THEN 'event_too_large'
         WHEN n_fields > 512 THEN 'attr_count_exceeded'
         WHEN depth > 16 THEN 'attr_depth_exceeded'
         WHEN long_path IS NOT NULL THEN 'string_too_long' END AS code,
    CASE WHEN x.eid IS NULL THEN 'event payload must be a JSON object'
         WHEN w.raw ->> '$.schema_version' <> 'v1' THEN 'unsupported_schema_version'
         WHEN n_fields > 512 THEN 'event field count exceeds max_attr_count (' || n_fields || ' > 512)'
         WHEN depth > 16 THEN 'event depth exceeds max_attr_depth (' || depth || ' > 16)'
         WHEN long_path IS NOT NULL
         THEN 'field ' || long_path || ' exceeds max_string_length (' || long_bytes || ' > 16384)' END AS message
  FROM wide w LEFT JOIN measures x ON w.eid = x.eid AND w.copy = x.copy
)"""
