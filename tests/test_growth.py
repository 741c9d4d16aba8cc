"""What keeps tasks, state and broadcasts small as tables grow."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from eventloom.functions import tokens
from eventloom.operators.joins import BROADCAST_ROWS, lookup_join
from eventloom.plans import catalog
from eventloom.plans.queries_streams import in_parts
from eventloom.plans.wide_events import TASK_ROWS, read_table
from eventloom.streaming import dedupe
from eventloom.sinks.tables import write_archive
from eventloom.sources.backlog import consume_backlog
from eventloom.streaming.jobs import read_backlog, redeliver

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def plan(df):
    return df._jdf.queryExecution().toString()


def event_table(spark, path, n=40):
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 600).cast("timestamp_ntz")
    spark.range(n).select(F.col("id").alias("event_id"), at.alias("ts"), (F.col("id") % 7).alias("user_id"), F.lit("view").alias("event_type"),
                          F.lit(1.5).alias("value"), F.lit('{"k": 1}').alias("props")).coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_tasks_keep_their_size_as_a_table_grows(spark, tmp_path):
    spark.range(12 * TASK_ROWS).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    assert read_table(spark, str(tmp_path), "t").rdd.getNumPartitions() == 12


def test_streamed_rows_are_computed_once(spark):
    draw = F.udf(lambda: random.randrange(10**6), "int").asNondeterministic()
    rows = spark.range(300).select("id", F.timestamp_seconds(draw()).alias("at"))
    seen = []

    def run(arriving):
        out = dedupe_path(spark)
        arriving.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-log").trigger(
            availableNow=True).start().awaitTermination()
        seen[:] = [r.id for r in spark.read.parquet(out).collect()]

    in_parts(rows, "at", run)
    assert sorted(seen) == list(range(300))


def dedupe_path(spark):
    from eventloom.session import scratch_path

    return scratch_path(spark, "growth")


def test_large_lookup_is_neither_broadcast_nor_multiplied(spark):
    left = spark.range(20).withColumn("v", F.lit("x"))
    joined = lookup_join(left, spark.range(BROADCAST_ROWS + 1).withColumn("w", F.col("id") * 2), ["id"])
    assert "explode" not in plan(joined) and sorted(r.w for r in joined.collect()) == list(range(0, 40, 2))


def test_keys_of_one_bucket_are_judged_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dedupe, "BUCKETS", 1)
    rows = [(k, START + timedelta(hours=h), i) for i, (k, h) in enumerate([("a", 0), ("b", 1), ("a", 2), ("c", 3), ("b", 30), ("a", 31), ("c", 20)])]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, "k string, ts timestamp, n int").coalesce(1).write.mode("append").parquet(source)
        judged = dedupe.dedupe_stream(spark.readStream.schema("k string, ts timestamp, n int").parquet(source), "k", "ts", ("n",), timedelta(hours=24))
        judged.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "log")) \
            .trigger(availableNow=True).start().awaitTermination()
    got = {r.n: r.duplicate for r in spark.read.parquet(out).collect()}
    assert got == {0: False, 1: False, 2: True, 3: False, 4: False, 5: False, 6: True}


def test_rows_with_and_without_a_key_are_computed_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("a", START, 1), ("a", START, 2**60 + 1), (None, START, None), (" ", START, 2**60 + 3), ("b", None, None), ("b", START, 6)]
    spark.createDataFrame(rows, "k string, ts timestamp, n long").coalesce(1).write.parquet(source)
    judged = dedupe.dedupe_stream(spark.readStream.schema("k string, ts timestamp, n long").parquet(source), "k", "ts", ("n",), timedelta(hours=24))
    done = []

    def keep(batch, batch_id):
        done.append(spark.streams.active[0]._jsq.explainInternal(False))
        batch.write.mode("append").parquet(out)

    judged.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert done[0].count("ReusedExchange") == 1 and done[0].count("Scan parquet") == 1
    got = Counter((r.k, r.ts is None, r.n, r.duplicate) for r in spark.read.parquet(out).collect())
    assert got == Counter([("a", False, 1, False), ("a", False, 2**60 + 1, True), (None, False, None, False), (" ", False, 2**60 + 3, False),
                           ("b", True, None, False), ("b", False, 6, False)])


def test_replayed_dead_letters_are_governed_once(spark, tmp_path, monkeypatch):
    from eventloom.plans import queries_streams

    seen = []
    monkeypatch.setattr(queries_streams, "redeliver", lambda records, *a, **b: seen.append(plan(records)) or redeliver(records, *a, **b))
    counts = queries_streams.dlq_redeliver(spark, event_table(spark, tmp_path)).first()
    # Of 40 events, two each have no version, too many fields, too much nesting, a long string, or are no object.
    assert tuple(counts)[:3] == (6, 10, 6)
    assert len(seen) == 2 and not any("events.parquet" in p for p in seen)


def test_backlog_lines_are_parsed_once_a_batch(spark, tmp_path):
    base, seen = str(tmp_path), []
    lines = ['{"a":1}', "{bad", "", " \u2003", ' {"b":2}\u00a0', "[3]", "{} x", '{"a":1}']
    spark.createDataFrame([(t,) for t in lines], "value string").coalesce(1).write.text(f"{base}/lines")

    def write(good, batch_id):
        seen.append((sorted(r.raw for r in good.collect()), good._jdf.queryExecution().optimizedPlan().toString()))

    consume_backlog(read_backlog(spark, f"{base}/lines"), f"{base}/position", write, f"{base}/bad").trigger(availableNow=True).start().awaitTermination()
    (good, plan_of_good), = seen
    # What is kept has the verdict; above it, no line is parsed.
    assert good == ['[3]', '{"a":1}', '{"a":1}', '{"b":2}'] and "parseJson" not in plan_of_good.split("InMemoryRelation")[0]
    assert sorted(r.raw for r in spark.read.json(f"{base}/bad").collect()) == ["{bad", "{} x"]


def test_backlog_files_grow_with_the_table(spark, tmp_path, monkeypatch):
    from eventloom.plans import queries_streams, wide_events

    sf_dir, written = event_table(spark, tmp_path, 80), []
    monkeypatch.setattr(wide_events, "TASK_ROWS", 2)
    monkeypatch.setattr(queries_streams, "FILE_TASKS", 4)
    monkeypatch.setattr(queries_streams, "read_backlog", lambda s, path, n: written.append(len(s.read.text(path).inputFiles())) or read_backlog(s, path, n))
    assert queries_streams.backlog_twice(spark, sf_dir).count() == 3
    # Forty tasks, a file for four of them or for each core; in the end, two parts.
    assert max(written) <= 2 * max(10, spark.sparkContext.defaultParallelism)


def test_archives_shuffle_no_texts(spark, tmp_path, monkeypatch):
    from eventloom.plans import queries_tables

    seen = []
    monkeypatch.setattr(queries_tables, "write_archive", lambda rows, *a, **b: seen.append(plan(rows)) or write_archive(rows, *a, **b))
    assert queries_tables.archive_write(spark, event_table(spark, tmp_path)).count() == 2 * 42
    assert len(seen) == 2 and all("rangepartitioning(ts" in p and "hashpartitioning" not in p for p in seen)


def test_tokens_are_read_outside_a_fold(spark, events):
    text = ' {"a" : {"s":[1,{"s":2}]}, "s" : {"x":[{}]} , "\\ud800":[{"s":"q\\"}"}], "":{"s":null}} '
    hidden = tokens.mask_members(F.col("raw"), lambda path, name, value: (name == "s") | F.endswith(value, F.lit('}"')), '"#"')
    rows = events(text, None).select("n", hidden.alias("m"), tokens.nodes(F.col("raw"), True).alias("nodes"))
    assert "aggregate" not in plan(rows)
    first, empty = sorted(rows.collect())
    assert first.m.raw == ' {"a" : {"s":"#"}, "s" : "#" , "\\ud800":[{"s":"#"}], "":{"s":"#"}}'
    assert first.m.paths == ["a.s", "s", "?.s", "s"] and empty.m is None and empty.nodes is None
    found = {n.path: (n.key, n.depth, n.value) for n in first.nodes}
    assert found["a.s[1]"] == (None, 4, '{"s":2}') and found["?[0].s"] == ("s", 4, '"q\\"}"') and found["s.x[0]"] == (None, 4, "{}")


def test_dead_letters_are_governed_once(spark, tmp_path):
    sf_dir = event_table(spark, tmp_path)
    catalog.load()
    for name in ("dlq_show", "dlq_delete"):
        assert "events.parquet" not in plan(catalog.QUERIES[name](spark, sf_dir))


def test_push_body_lines_are_told_apart_by_digests(spark, tmp_path):
    catalog.load()
    bodies = catalog.QUERIES["loki_batches"](spark, event_table(spark, tmp_path))
    assert "sha2(" in plan(bodies) and bodies.first().texts == 44
