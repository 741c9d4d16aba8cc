"""Queries over the stored table: layout, deletion, retention, search and SQL."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, functions as F

from eventloom.functions.crypto import decrypt_column
from eventloom.functions.paths import string_at
from eventloom.operators.governance import parse_events
from eventloom.operators.lifecycle import (
    delete_rows, event_rows, older_than, retain_by_age, retain_by_size, tenant_of, tenant_rows, user_rows,
)
from eventloom.operators.projection import typed_projection
from eventloom.operators.rewrite import file_summaries, retain_age_table, retain_size_table, rewrite_without
from eventloom.operators.search import run_query, search_count
from eventloom.plans.catalog import query
from eventloom.plans.queries_events import ROW, objects
from eventloom.plans.wide_events import OBJECTS_SQL, WIDE_SQL, wide_events, wide_events_by_time
from eventloom.session import scratch_path, staged
from eventloom.sinks.layout import archive_key, with_layout
from eventloom.sinks.tables import export_parquet, write_archive, write_events_table

_NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)

_STORED_SQL = OBJECTS_SQL + """,
stored AS (
  SELECT eid, copy, ts, raw, raw ->> '$.tenant.id' AS tenant_id, raw ->> '$.user.id' AS user_id,
    CASE WHEN json_type(raw, '$.event_id') = 'VARCHAR' THEN raw ->> '$.event_id' END AS event_id FROM objects
)"""


def stored(spark, sf_dir) -> DataFrame:
    """The stored table: events with their arrival time and the columns deletion needs."""
    rows = tenant_of(objects(spark, sf_dir)).withColumn("event_id", string_at(F.col("doc"), "event_id"))
    return rows.drop("doc")


@query("archive_layout", f"""WITH {WIDE_SQL}
SELECT 'analytics_wide_events' AS dataset, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour, count(*) AS events,
  min('archive/raw/dataset=analytics_wide_events/date=' || strftime(ts, '%Y-%m-%d') || '/hour=' || strftime(ts, '%H') ||
      '/part-' || epoch_us(ts) * 1000 || '.ndjson') AS first_key
FROM wide GROUP BY 1, 2, 3""")
def archive_layout(spark, sf_dir):
    """Events per archive folder, and the first object name in each."""
    name = "analytics\\wide.events"
    rows = with_layout(wide_events(spark, sf_dir), F.col("ts"), name)
    key = archive_key(F.col("ts"), F.unix_micros("ts") * 1000, "/archive/raw/", name)
    return rows.withColumn("key", key).groupBy("dataset", "date", "hour").agg(
        F.count("*").alias("events"), F.min("key").alias("first_key"))


@query("delete_tenant", f"WITH {_STORED_SQL} SELECT tenant_id, count(*) AS kept FROM stored WHERE tenant_id <> 't1' GROUP BY 1")
def delete_tenant(spark, sf_dir):
    kept = stored(spark, sf_dir).where(~F.coalesce(tenant_rows("t1"), F.lit(False)))
    return kept.groupBy("tenant_id").agg(F.count("*").alias("kept"))


@query("delete_user", f"""WITH {_STORED_SQL}
SELECT eid, copy FROM stored
WHERE user_id IS DISTINCT FROM 'u-7' AND (raw ->> '$.context.user_id') IS DISTINCT FROM 'u-7'""")
def delete_user(spark, sf_dir):
    """Events of a user by column or by a ``user_id`` member at any depth, removed by anti join."""
    rows = stored(spark, sf_dir)
    return delete_rows(rows, user_rows(rows, "u-7", ROW), ROW).select(*ROW)


@query("delete_by_member", f"""WITH {_STORED_SQL}
SELECT count(*) AS kept, count(DISTINCT user_id) AS users FROM stored
WHERE (raw ->> '$.context.user_id') IS DISTINCT FROM 'u-7'""")
def delete_by_member(spark, sf_dir):
    """A table without a user column: only the member inside the event tells."""
    rows = stored(spark, sf_dir)
    doomed = user_rows(rows.drop("user_id"), "u-7", ROW)
    return delete_rows(rows, doomed, ROW).agg(
        F.count("*").alias("kept"), F.countDistinct("user_id").alias("users"))


@query("delete_event", f"""WITH {_STORED_SQL}
SELECT count(*) AS kept, count(*) FILTER (event_id = 'evt_12') AS left_over FROM stored
WHERE event_id IS DISTINCT FROM 'evt_12'""")
def delete_event(spark, sf_dir):
    kept = stored(spark, sf_dir).where(~F.coalesce(event_rows("evt_12"), F.lit(False)))
    return kept.agg(F.count("*").alias("kept"), F.count_if(F.col("event_id") == "evt_12").alias("left_over"))


def stored_table(spark, sf_dir, name: str) -> str:
    """The stored table, written by the hour of its events below the shared folder."""
    path = scratch_path(spark, name)
    # Dealt out by day, so that an hour is one file.
    write_events_table(stored(spark, sf_dir).repartition(F.to_date("ts")), path, written=F.col("ts"))
    return path


@query("rewrite_tenant", f"""WITH {_STORED_SQL}
SELECT eid, copy, tenant_id, (SELECT count(*) FROM stored WHERE tenant_id = 't1') AS deleted FROM stored
WHERE tenant_id IS DISTINCT FROM 't1'""")
def rewrite_tenant(spark, sf_dir):
    """Deletion by tenant on a stored table, read back with the count of the audit line."""
    path, audit = stored_table(spark, sf_dir, "by-tenant"), scratch_path(spark, "audit")
    rewrite_without(spark, path, tenant_rows("t1"), "by_tenant", "request", audit)
    deleted = spark.read.parquet(audit).where("type = 'by_tenant'").select(F.col("deleted").cast("long").alias("deleted"))
    return spark.read.parquet(path).select(*ROW, "tenant_id").crossJoin(F.broadcast(deleted))


@query("rewrite_user", f"""WITH {_STORED_SQL}
SELECT eid, copy, md5(raw) AS digest, strftime(ts, '%Y-%m-%d %H') AS hour FROM stored
WHERE user_id IS DISTINCT FROM 'u-7' AND (raw ->> '$.context.user_id') IS DISTINCT FROM 'u-7'""")
def rewrite_user(spark, sf_dir):
    """Deletion by user, by column or by a member of the event, on a stored table; kept rows stay in their hour as they were."""
    path = stored_table(spark, sf_dir, "by-user")
    doomed = staged(user_rows(spark.read.parquet(path), "u-7", ROW), "doomed")
    rewrite_without(spark, path, doomed, "by_user")
    return spark.read.parquet(path).select(*ROW, F.md5("raw").alias("digest"), F.concat_ws(" ", "date", "hour").alias("hour"))


@query("deletion_report", f"""WITH {_STORED_SQL}
SELECT 'by_tenant' AS type, count(*) AS deleted, 'request 1' AS reason FROM stored WHERE tenant_id = 't2'
UNION ALL SELECT 'by_event_id', count(*), 'request 2' FROM stored WHERE event_id = 'evt_12' AND tenant_id IS DISTINCT FROM 't2'
UNION ALL SELECT 'by_user', count(*), '' FROM stored WHERE tenant_id IS DISTINCT FROM 't2' AND user_id = 'u-7'
  AND event_id IS DISTINCT FROM 'evt_12'""")
def deletion_reports(spark, sf_dir):
    """Audit lines of three deletions on one stored table, each after the one before."""
    path, audit = stored_table(spark, sf_dir, "reported"), scratch_path(spark, "audit")
    rewrite_without(spark, path, tenant_rows("t2"), "by_tenant", "request 1", audit)
    rewrite_without(spark, path, event_rows("evt_12"), "by_event_id", "request 2", audit)
    rewrite_without(spark, path, F.col("user_id") == "u-7", "by_user", "", audit)
    return spark.read.parquet(audit).select("type", F.col("deleted").cast("long").alias("deleted"), "reason")


@query("table_write", f"""WITH {OBJECTS_SQL}
SELECT strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour, raw ->> '$.event_id' AS event_id, raw ->> '$.event' AS event_type,
  CAST(raw ->> '$.http.status' AS INTEGER) AS status_code, CAST(raw ->> '$.duration_ms' AS DOUBLE) AS duration_ms, md5(raw) AS digest
FROM objects""")
def table_write(spark, sf_dir):
    """The analytics table, written in two parts by hour and read back with its types."""
    path = scratch_path(spark, "table")
    typed = typed_projection(objects(spark, sf_dir), keep=("eid", "ts")).repartition(F.to_date("ts"))
    for part in range(2):
        rows = typed.where(F.pmod("eid", F.lit(2)) == part)
        write_events_table(rows.drop("eid"), path, written=F.col("ts"))
    return spark.read.parquet(path).select("date", "hour", "event_id", "event_type", "status_code", "duration_ms", F.md5("raw").alias("digest"))


@query("archive_write", f"""WITH {OBJECTS_SQL}
SELECT 'plain' AS form, 'wide_events' AS dataset, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour, md5(raw) AS digest FROM objects
UNION ALL SELECT 'sealed', 'wide_events', strftime(ts, '%Y-%m-%d'), strftime(ts, '%H'), md5(raw) FROM objects""")
def archive_write(spark, sf_dir):
    """The archive, plain and encrypted, written under its layout and read back line by line."""
    events = parse_events(wide_events_by_time(spark, sf_dir))
    rows, base = events.where(F.col("doc").isNotNull()), scratch_path(spark, "archive")

    def back(form: str, passphrase: str) -> DataFrame:
        write_archive(rows, base, f"/{form}/raw/", "wide.events", F.col("ts"), passphrase=passphrase, lines_per_file=100)
        lines = spark.read.text(f"{base}/{form}/raw")
        plain = decrypt_column(F.col("value"), passphrase)
        sealed = F.startswith("value", F.lit("enc:")) == F.lit(bool(passphrase))
        return lines.select(F.lit(form).alias("form"), "dataset", "date", "hour", F.when(sealed, F.md5(plain)).alias("digest"))

    return back("plain", "").unionByName(back("sealed", "passphrase"))


@query("export_hours", f"""WITH {_STORED_SQL}
SELECT 'wide_events' AS "table", strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour, count(*) AS events,
  CAST(sum(strlen(raw)) AS BIGINT) AS bytes FROM stored
WHERE ts >= TIMESTAMP '2024-01-05 03:00:00' AND ts < TIMESTAMP '2024-01-09 20:00:00' GROUP BY 1, 2, 3""")
def export_hours(spark, sf_dir):
    """Hours exported in two runs that overlap: an hour is there once."""
    path, out = stored_table(spark, sf_dir, "exported"), scratch_path(spark, "export")
    for since, until in ((datetime(2024, 1, 5, 3), datetime(2024, 1, 8, 1)), (datetime(2024, 1, 7, 22), datetime(2024, 1, 9, 20))):
        export_parquet(spark, path, out, "wide.events", since, until)
    return spark.read.parquet(out).groupBy("table", "date", "hour").agg(
        F.count("*").alias("events"), F.sum(F.octet_length("raw")).alias("bytes"))


@query("retain_age_table", f"""WITH {_STORED_SQL}
SELECT eid, copy FROM stored WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-20 12:30:00'""")
def retention_by_age(spark, sf_dir):
    """Retention by age on a stored table: whole hours unread, the hour on the edge rewritten."""
    path = stored_table(spark, sf_dir, "by-age")
    retain_age_table(spark, path, "ts", _NOW + timedelta(hours=12, minutes=30), 11)
    return spark.read.parquet(path).select(*ROW)


@query("retain_size_table", f"""WITH {_STORED_SQL}, sized AS (
  SELECT *, row_number() OVER (ORDER BY ts) AS age_rank, sum(strlen(raw)) OVER () AS total, avg(strlen(raw)) OVER () AS mean
  FROM stored)
SELECT eid, copy FROM sized WHERE age_rank > ceil((total - total // 3) / mean)""")
def retention_by_size(spark, sf_dir):
    """Retention by size on a stored table, from the summaries of its files."""
    path = stored_table(spark, sf_dir, "by-size")
    limit = file_summaries(spark, path).agg(F.sum("bytes")).first()[0] // 3
    retain_size_table(spark, path, "ts", ("eid", "copy"), limit)
    return spark.read.parquet(path).select(*ROW)


@query("retain_age", f"""WITH {_STORED_SQL}
SELECT eid, copy FROM stored WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-21 00:00:00'""")
def retain_age(spark, sf_dir):
    return retain_by_age(stored(spark, sf_dir), "ts", _NOW, 10).select(*ROW)


@query("expired_partitions", f"""WITH {_STORED_SQL}
SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS expired FROM stored
WHERE ts < TIMESTAMP '2024-01-21 00:00:00' GROUP BY 1""")
def expired_partitions(spark, sf_dir):
    """What retention by age removes, per day."""
    gone = stored(spark, sf_dir).where(older_than("ts", _NOW, 10))
    return gone.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("expired"))


@query("retain_size", f"""WITH {_STORED_SQL}, sized AS (
  SELECT *, row_number() OVER (ORDER BY ts) AS age_rank, sum(strlen(raw)) OVER () AS total, avg(strlen(raw)) OVER () AS mean
  FROM stored)
SELECT eid, copy FROM sized WHERE age_rank > ceil((total - total // 3) / mean)""")
def retain_size(spark, sf_dir):
    """Only a third of the bytes may stay: the oldest events go."""
    rows = stored(spark, sf_dir)
    limit = rows.agg(F.sum(F.octet_length("raw"))).first()[0] // 3
    return retain_by_size(rows, "ts", ("eid", "copy"), limit).select(*ROW)


@query("search_count", f"WITH {WIDE_SQL} SELECT count(*) AS matches FROM wide WHERE contains(raw, 'Bearer abc')")
def search(spark, sf_dir):
    return search_count(wide_events(spark, sf_dir), "Bearer abc")


@query("sql_query", f"""WITH {OBJECTS_SQL}
SELECT raw ->> '$.service' AS service, CAST(raw ->> '$.http.status' AS INTEGER) AS status_code, count(*) AS events,
  round(sum(CAST(raw ->> '$.duration_ms' AS DOUBLE)), 2) AS total_ms
FROM objects GROUP BY 1, 2""")
def sql_query(spark, sf_dir):
    """Read-only SQL over the typed table."""
    table = typed_projection(objects(spark, sf_dir))
    return run_query(spark, """
        SELECT service, status_code, count(*) AS events, round(sum(duration_ms), 2) AS total_ms
        FROM stored_events GROUP BY service, status_code ORDER BY events DESC, service, status_code
    """, {"stored_events": table})


@query("sql_join", f"""WITH {OBJECTS_SQL}
SELECT o.raw ->> '$.service' AS service, d.lang, count(*) AS events
FROM objects o JOIN documents d ON d.doc_id = o.eid GROUP BY 1, 2""")
def sql_join(spark, sf_dir):
    """SQL over two tables at once."""
    table = typed_projection(objects(spark, sf_dir), keep=ROW)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    return run_query(spark, """
        SELECT service, lang, count(*) AS events FROM stored_events JOIN docs ON doc_id = eid GROUP BY service, lang
    """, {"stored_events": table, "docs": documents})
