"""Deletion and retention on a stored parquet table: whole files are replaced, by way of a journal.

A job works out which files hold doomed rows, writes their other rows beside the table, and then its plan: what is to go and what
is to come.  From then on the job is decided.  Applying a plan moves the new files in, deletes the old ones, writes the audit line
and removes the plan; every step may be done again, so a job that was lost on the way is completed by the next call, whatever that
call is for.  Files without a doomed row are neither read in full nor written.

One job changes a table at a time.  A reader that starts while a plan is applied may see kept rows twice, but never misses one.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventloom.operators.joins import lookup_join
from eventloom.operators.lifecycle import deletion_report, older_than, oldest_rows
from eventloom.sinks.files import Files

# Spark does not read folders whose name begins with an underscore.
_JOURNAL, _SUMMARY = "_journal", "_summary"
_SUMMARY_SHAPE = "file string, date string, hour string, bytes bigint, rows bigint"


def rewrite_without(spark: SparkSession, path: str, doomed: Column | DataFrame, kind: str, reason: str = "",
                    audit_path: str | None = None) -> int:
    """Deletes the rows that satisfy a predicate, or whose columns are among the rows of ``doomed``; returns how many.

    The table is read for the columns of the test alone; then only the files with such rows are read in full.  A predicate that
    is NULL keeps its row.
    """
    finish_rewrites(spark, path)
    table = spark.read.parquet(path)
    named = table.withColumn("_file", F.col("_metadata.file_path"))
    by_key = isinstance(doomed, DataFrame)
    hits = lookup_join(named.select(*doomed.columns, "_file"), doomed, doomed.columns, "left_semi") if by_key else named.where(doomed)
    # One row per file that has to change.
    counts = hits.groupBy("_file").agg(F.count("*").alias("n")).collect()
    files = [Files(spark, path).decoded(row["_file"]) for row in counts]
    if files:
        rows = _read(spark, table, path, files)
        kept = lookup_join(rows, doomed, doomed.columns, "left_anti") if by_key else rows.where(~F.coalesce(doomed, F.lit(False)))
    else:
        kept = None
    return _replace(spark, path, files, kept, sum(row["n"] for row in counts), kind, reason, audit_path)


def _read(spark: SparkSession, table: DataFrame, path: str, files: list[str]) -> DataFrame:
    return spark.read.schema(table.schema).option("basePath", path).parquet(*files)


def _replace(spark: SparkSession, path: str, files: list[str], kept: DataFrame | None, deleted: int, kind: str, reason: str,
             audit_path: str | None) -> int:
    """Writes the plan of a job and applies it."""
    job = uuid.uuid4().hex
    base = f"{path}/{_JOURNAL}/{job}"
    table = spark.read.parquet(path)
    levels = [part for part in files[0].split("/")[:-1] if "=" in part and part.split("=")[0] in table.columns] if files else []
    columns = [level.split("=")[0] for level in levels]
    if kept is not None:
        kept.write.partitionBy(*columns).parquet(f"{base}/kept")
    if len(files) == len(table.inputFiles()):
        # A table that may lose every row keeps its schema, in a file without rows.
        table.drop(*columns).limit(0).coalesce(1).write.mode("append").parquet("/".join([f"{base}/kept", *levels]))
    plan = {"files": files, "deleted": deleted, "kind": kind, "reason": reason, "audit": audit_path}
    # The folder appears under its name in one step, so a plan is there in full or not at all.
    spark.createDataFrame([(json.dumps(plan),)], "value string").coalesce(1).write.text(f"{base}/plan.new")
    Files(spark, path).move(f"{base}/plan.new", f"{base}/plan")
    _apply(spark, path, job)
    return deleted


def finish_rewrites(spark: SparkSession, path: str) -> list[str]:
    """Completes jobs that have a plan, removes what is left of others; returns the jobs completed."""
    files, done = Files(spark, path), []
    for job in files.folders(f"{path}/{_JOURNAL}"):
        if files.exists(f"{path}/{_JOURNAL}/{job}/plan"):
            _apply(spark, path, job)
            done.append(job)
        else:
            files.delete(f"{path}/{_JOURNAL}/{job}")
    return done


def _apply(spark: SparkSession, path: str, job: str) -> None:
    files, base = Files(spark, path), f"{path}/{_JOURNAL}/{job}"
    plan = json.loads(spark.read.text(f"{base}/plan").first()["value"])
    for name in files.below(f"{base}/kept"):
        if name.endswith(".parquet"):
            files.move(f"{base}/kept/{name}", "/".join([path, *name.split("/")[:-1], f"{job}-{os.path.basename(name)}"]))
    for name in plan["files"]:
        files.delete(name)
    if plan["audit"]:
        report = spark.range(1).select(*deletion_report(plan["kind"], F.lit(plan["deleted"]), plan["reason"]))
        # A folder of the job's own, so that a second run replaces its line.
        report.write.mode("overwrite").parquet(f"{plan['audit']}/job={job}")
    files.delete(base)


def file_summaries(spark: SparkSession, path: str) -> DataFrame:
    """``(file, date, hour, bytes, rows)`` of every file of a table with a column ``raw``, kept beside it.

    Only files that are not in it yet are read, and of them only the length of ``raw``; files that are gone drop out.
    """
    files, table = Files(spark, path), spark.read.parquet(path)
    present = [files.decoded(f) for f in table.inputFiles()]
    place = f"{path}/{_SUMMARY}"
    # One row per file; the driver has listed them all to plan the read.
    known = {r["file"] for r in spark.read.schema(_SUMMARY_SHAPE).parquet(place).select("file").collect()} if files.exists(place) else set()
    fresh = [f for f in present if f not in known]
    if fresh:
        rows = _read(spark, table, path, fresh).select(
            F.col("_metadata.file_path").alias("address"), "date", "hour", F.octet_length("raw").alias("size"))
        sums = rows.groupBy("address", "date", "hour").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        names = {r["address"]: r for r in sums.collect()}
        made = [(files.decoded(a), r["date"], r["hour"], r["bytes"] or 0, r["rows"]) for a, r in names.items()]
        # A file without rows is remembered too.
        made += [(f, None, None, 0, 0) for f in set(fresh) - {m[0] for m in made}]
        spark.createDataFrame(made, _SUMMARY_SHAPE).coalesce(1).write.mode("append").parquet(place)
    now = spark.createDataFrame([(f,) for f in present], "file string")
    return spark.read.schema(_SUMMARY_SHAPE).parquet(place).dropDuplicates(["file"]).join(now, "file", "left_semi")


def retain_age_table(spark: SparkSession, path: str, at: str, now: datetime, days: int, audit_path: str | None = None) -> int:
    """Deletes rows older than ``days`` from a table laid out by ``at`` in UTC hours; returns how many.

    Files of earlier hours are dropped unread, those of the hour on the edge are rewritten; later hours are not looked at.
    """
    finish_rewrites(spark, path)
    edge = (now - timedelta(days=days)).strftime("%Y-%m-%d %H")
    hour = F.concat_ws(" ", "date", "hour")
    known = file_summaries(spark, path)
    gone = known.where(hour < edge).collect()
    on_edge = [r["file"] for r in known.where(hour == edge).collect()]
    return _drop(spark, path, gone, on_edge, lambda rows: older_than(at, now, days), "by_age", audit_path)


def retain_size_table(spark: SparkSession, path: str, at: str, tie: tuple[str, ...], max_bytes: int,
                      audit_path: str | None = None) -> int:
    """Deletes the oldest rows of a table laid out by ``at`` until its texts fit the limit on average; returns how many.

    The summaries say in which hour the cut falls; only that hour is read.  Ties are broken by a hash of ``tie``.
    """
    finish_rewrites(spark, path)
    known = file_summaries(spark, path)
    hours = known.where("rows > 0").groupBy("date", "hour").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    # One row per hour of the table.
    sizes = sorted((r["date"], r["hour"], r["bytes"], r["rows"]) for r in hours.collect())
    total, count = sum(s[2] for s in sizes), sum(s[3] for s in sizes)
    if total <= max_bytes:
        return 0
    left, gone_hours, edge = math.ceil((total - max_bytes) / (total / count)), [], None
    for date, hour, _, rows in sizes:
        if left < rows:
            edge = f"{date} {hour}"
            break
        gone_hours.append(f"{date} {hour}")
        left -= rows
    name = F.concat_ws(" ", "date", "hour")
    last_gone = gone_hours[-1] if gone_hours else ""
    gone = known.where(name <= last_gone).collect()
    on_edge = [r["file"] for r in known.where(name == edge).collect()] if left and edge else []
    return _drop(spark, path, gone, on_edge, lambda rows: oldest_rows(rows, at, tie, left), "by_size", audit_path)


def _drop(spark: SparkSession, path: str, gone: list, on_edge: list[str], old, kind: str, audit_path: str | None) -> int:
    """Drops whole files, and rewrites those on the edge without their old rows."""
    files, deleted, kept = [r["file"] for r in gone], sum(r["rows"] for r in gone), None
    if on_edge:
        rows = _read(spark, spark.read.parquet(path), path, on_edge)
        doomed = F.coalesce(old(rows), F.lit(False))
        n = rows.where(doomed).count()
        if n:
            kept, deleted, files = rows.where(~doomed), deleted + n, on_edge + files
    return _replace(spark, path, files, kept, deleted, kind, "retention", audit_path) if files else 0
