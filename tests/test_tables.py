"""Dedupe, delivery, requests, registry, projection and the stored table."""

import gzip
import json
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.config import DEFAULT_REGISTRY, DeliveryRules, RegistryEntry, RequestLimits, RetryRules, SchemaRules
from eventloom.functions.crypto import decrypt_column, encrypt_column
from eventloom.functions.paths import extract_tenant
from eventloom.operators import registry as reg
from eventloom.operators.dead_letters import dlq_delete, dlq_records, dlq_show
from eventloom.operators.dedupe import dedupe_window, transfer
from eventloom.operators.delivery import evaluate_delivery, retry_waits
from eventloom.operators.governance import govern, parse_events
from eventloom.operators.joins import lookup_join
from eventloom.operators import rewrite
from eventloom.operators.lifecycle import older_than, retain_by_size, user_rows
from eventloom.operators.rewrite import finish_rewrites, retain_age_table, retain_size_table, rewrite_without
from eventloom.operators.projection import parse_level, project_encoded, typed_projection
from eventloom.operators.redaction import pii_audit
from eventloom.operators.responses import acks, batch_response
from eventloom.operators.search import is_read_only, query_result, run_query
from eventloom.sinks import external, layout, push_payloads, tables
from eventloom.sources.backlog import read_dlq, replay_backlog
from eventloom.sources.otlp import OtlpSettings, flatten_otlp_logs, otlp_errors
from eventloom.sources.payloads import decode_bodies, explode_payloads, read_payload_files, request_guards
from eventloom.sources.queue import queue_options

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def brute_force(rows, window):
    """First-kept rule, row by row."""
    last, out = {}, {}
    for key, hour, n in sorted(rows, key=lambda r: (r[1], r[2])):
        if key is None or not key.strip():
            out[n] = False
            continue
        out[n] = key in last and hour - last[key] <= window
        if not out[n]:
            last[key] = hour
    return out


@pytest.mark.parametrize("chunk", [1, 5, 1000])
def test_dedupe_rule(spark, chunk):
    rows = [("a", h, i) for i, h in enumerate((0, 20, 30, 30, 54, 55, 200))]
    rows += [("b", 5 * i % 97, 100 + i) for i in range(60)] + [(None, 0, 900), (" ", 0, 901), (" ", 1, 902), ("c", 7, 903)]
    df = spark.createDataFrame([(k, START + timedelta(hours=h), n) for k, h, n in rows], "k string, ts timestamp, n int")
    got = dedupe_window(df, "k", "ts", ("n",), timedelta(hours=24), chunk_times=chunk)
    assert {r.n: r.duplicate for r in got.collect()} == brute_force(rows, 24)


def test_dedupe_without_times_and_with_ties(spark):
    rows = [("a", START, 3), ("a", START, 1), ("a", START, 1), ("a", None, 0), ("a", None, 0), ("a", START + timedelta(hours=25), 5)]
    got = dedupe_window(spark.createDataFrame(rows, "k string, ts timestamp, n int"), "k", "ts", ("n",), timedelta(hours=24))
    assert sorted((r.n, r.ts is None, r.duplicate) for r in got.collect()) == [
        (0, True, False), (0, True, False), (1, False, False), (1, False, False), (3, False, True), (5, False, False)]


def test_transfers_compose():
    rng = random.Random(6)
    for _ in range(300):
        window = rng.choice([0, 1, 5, 40])
        times = sorted(rng.sample(range(400), rng.randint(1, 120)))
        kept, last = [], None
        for t in times:
            if last is None or t - last > window:
                last = t
            kept.append(last)
        cuts = sorted(rng.sample(range(len(times) + 1), min(len(times), 4)))
        state = None
        for first, end in zip([0, *cuts], [*cuts, len(times)]):
            if first == end:
                continue
            limits, exits = transfer(np.array(times[first:end]), window)
            place = 0 if state is None else int(np.searchsorted(limits, state, side="right"))
            state = int(exits[place]) if place < len(limits) else state
            assert state == kept[end - 1]
            assert (np.diff(exits) != 0).all() and (np.diff(limits) > 0).all()


def test_the_first_registry_entry_counts_wherever_it_lies(spark, tmp_path):
    rows = [("v1", "v1", ["first"], 0), ("v1", "v1", ["a", "second"], 1), ("v2", "v1", ["x"], 2)]
    placed = spark.createDataFrame(rows, reg.REGISTRY_SCHEMA + ", place int")
    for table in (placed, placed.repartition(5, "required_fields"), placed.orderBy(F.desc("place"))):
        assert {r.schema_version: r.required_fields for r in reg.first_entries(table).collect()} == {"v1": ["first"], "v2": ["x"]}
        unplaced = reg.first_entries(table.drop("place")).collect()
        assert {r.schema_version: r.required_fields for r in unplaced} == {"v1": ["a", "second"], "v2": ["x"]}
    path = str(tmp_path / "registry")
    placed.coalesce(1).orderBy("place").select(F.to_json(F.struct(*reg.REGISTRY_COLUMNS)).alias("value")).coalesce(1).write.text(path)
    loaded = reg.load_registry(spark, path).repartition(3, "required_fields")
    assert {r.schema_version: r.required_fields for r in loaded.collect()} == {"v1": ["first"], "v2": ["x"]}
    reg.save_registry(loaded, path)
    assert reg.load_registry(spark, path).count() == 2


def test_encoded_bodies(spark):
    import zstandard

    def pack(text):
        return zstandard.ZstdCompressor().compress(text.encode())

    big = '{"a":"' + "".join(map(str, range(200_000))) + '"}'
    half = pack(big)[:len(pack(big)) // 2]
    rows = [("two.zst", pack('{"a":1}\n') + pack('{"a":2}')), ("cut.zst", half), ("cut2.zst", pack('{"a":1}\n') + pack(big)[:50]),
            ("junk.zst", pack("{}") + b"junk"), ("empty.zst", b""), ("two.gz", gzip.compress(b"{") + gzip.compress(b"}")),
            ("cut.gz", gzip.compress(big.encode())[:-9]), ("big.zst", pack("x" * 3_000_000)), ("plain", b"{}")]
    got = {r.request_id: (r.payload, r.too_large) for r in
           decode_bodies(spark.createDataFrame(rows, "request_id string, content binary"), RequestLimits(max_body_bytes=2_000_000)).collect()}
    nothing = (None, False)
    assert got == {"two.zst": ('{"a":1}\n{"a":2}', False), "cut.zst": nothing, "cut2.zst": nothing, "junk.zst": nothing, "empty.zst": ("", False),
                   "two.gz": ("{}", False), "cut.gz": nothing, "big.zst": (None, True), "plain": ("{}", False)}


def test_lookup_join_beyond_the_broadcast_bound(spark):
    left = spark.createDataFrame([("k" if i % 3 else f"v{i}", i) for i in range(300)], "key string, n int")
    small = spark.createDataFrame([("k", 1), ("v0", 2), ("z", 3)], "key string, x int")
    rows = lookup_join(left, small, ["key"], broadcast_rows=1)
    plain = left.join(small, "key", "left")
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


@pytest.mark.parametrize("policy, primary, secondary, delivered", [
    ("require_primary", False, True, False), ("", True, False, True), ("require_all", True, False, False),
    ("best_effort", False, True, True), ("best_effort", False, False, False),
])
def test_policies(spark, policy, primary, secondary, delivered):
    rows = spark.createDataFrame(
        [("e", "p", "primary", primary, None if primary else "p down"), ("e", "s", "secondary", secondary, None if secondary else "s down")],
        "event_key string, sink string, role string, ok boolean, error string")
    row = evaluate_delivery(rows, DeliveryRules(policy=policy, dlq_enabled=True)).first()
    assert row.delivered is delivered
    assert row.dead_letter is (not delivered or not primary)
    assert (row.policy_error is None) is delivered


def test_retry_waits():
    assert retry_waits(RetryRules(max_attempts=5, initial_backoff=1, max_backoff=3)) == [1, 2, 3, 3]
    assert retry_waits(RetryRules(enabled=False)) == []


def requests(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "request_id int, payload string")


def test_request_bodies(spark):
    bodies = [
        '[{"event":"a"},  {"b": 1.0, "a":[1, 2]} , "x", null, 12.50]', '{"events":[{"event":"a"},{"event":"b"}]}',
        '{"event":"a"}\n\n {"event":"b"} \r\n', '{"event":"a"}', '{"events":[]}', '{"events":3}', "  ", "{bad", "[1",
        '{"a":1}\n{bad', '{"EVENTS":[{"a":1}],"source":{"sdk":"x"}}', '{"events":[{"a":1}],"source":{"sdk":1}}', "x\ny",
    ]
    rows = request_guards(requests(spark, *bodies)).orderBy("request_id").collect()
    assert [r["items"] for r in rows] == [
        ['{"event":"a"}', '{"b": 1.0, "a":[1, 2]}', '"x"', "null", "12.50"], ['{"event":"a"}', '{"event":"b"}'],
        ['{"event":"a"}', '{"event":"b"}'], ['{"event":"a"}'], ['{"events":[]}'], ['{"events":3}'], [], None, None,
        ['{"a":1}', "{bad"], ['{"a":1}'], [bodies[11]], ["x", "y"]]
    assert [r.request_error for r in rows][6:9] == ["empty_event_payload", "invalid_request_payload", "invalid_request_payload"]
    tight = request_guards(requests(spark, "[1,2,3]", '"' + "x" * 50 + '"'), RequestLimits(max_body_bytes=40, max_events=2))
    assert [r.request_error for r in tight.orderBy("request_id").collect()] == ["max_events_exceeded", "payload_too_large"]


def test_deep_array_elements(spark):
    deep = "[" * 100 + "1" + "]" * 100
    rows = explode_payloads(requests(spark, f'[{deep},{{"a":1}}]')).orderBy("index").collect()
    assert [r.raw for r in rows] == [deep, '{"a":1}']


def test_partial_batch(spark):
    events = govern(explode_payloads(requests(spark, '[{"event":"a"},123]', "[1]")))
    acked = acks(events.withColumn("duplicate", F.lit(False)))
    rows = batch_response(acked, with_acks=True).orderBy("request_id").collect()
    assert [(r.accepted, r.invalid, r.rejected, r.status, r.http_status) for r in rows] == [
        (1, 1, 0, "partial", 207), (0, 1, 0, "invalid", 400)]
    assert [a.code for a in rows[0].acks] == ["accepted", "expected_json_object"]


def test_payload_files(spark, tmp_path):
    zstandard = pytest.importorskip("zstandard")
    (tmp_path / "a.json.gz").write_bytes(gzip.compress(b'[{"a":1}]'))
    (tmp_path / "b.json.zst").write_bytes(zstandard.ZstdCompressor().compress(b'{"b":2}\n{"c":3}'))
    (tmp_path / "c.json").write_bytes(b'{"d":4}')
    (tmp_path / "d.json.gz").write_bytes(b"not gzip")
    rows = request_guards(read_payload_files(spark, str(tmp_path))).collect()
    got = {r.request_id.rsplit("/", 1)[-1]: (r["items"], r.request_error) for r in rows}
    assert got == {"a.json.gz": (['{"a":1}'], None), "b.json.zst": (['{"b":2}', '{"c":3}'], None),
                   "c.json": (['{"d":4}'], None), "d.json.gz": (None, "invalid_request_payload")}


def test_payload_file_over_the_limit_is_refused(spark, tmp_path):
    (tmp_path / "long.json").write_bytes(b'{"n":1}\n' * 1000)
    (tmp_path / "short.json").write_bytes(b'{"n":1}\n' * 2)
    limits = RequestLimits(max_body_bytes=500)
    bodies = read_payload_files(spark, str(tmp_path), limits)
    got = {r.request_id.rsplit("/", 1)[-1]: (r.request_error, r.http_status) for r in request_guards(bodies, limits).collect()}
    assert got == {"long.json": ("payload_too_large", 413), "short.json": (None, None)}
    assert explode_payloads(bodies).count() == 2


def test_schema_modes(spark, events):
    texts = ('{"event_id":1,"event":null,"timestamp":"t"}', '{"event_id":1}', '{"schema_version":"v7"}')
    registry = reg.registry_table(spark, DEFAULT_REGISTRY)

    def routes(mode, table=registry):
        rows = reg.check_schema(parse_events(events(*texts)), table, SchemaRules(mode=mode)).orderBy("n").collect()
        return [r.schema_route for r in rows], rows

    assert routes("reject")[0] == ["pass", "invalid", "invalid"]
    assert routes("quarantine")[0] == ["pass", "quarantine", "quarantine"]
    warned, rows = routes("warn")
    assert warned == ["pass", "warn", "pass"] and rows[1].raw == texts[1]
    assert json.loads(rows[0].raw)["schema_version"] == "v1"
    assert routes("reject", registry.limit(0))[0] == ["pass"] * 3


def test_registry_diff_publish_and_file(spark, tmp_path):
    current = reg.registry_table(spark, [RegistryEntry("v1", "v1", ("event_id", "timestamp"))])
    proposed = reg.registry_table(spark, [RegistryEntry(" v1", "v1", ("service", " event_id ", "service", ""))])
    row = reg.schema_diff(current, proposed).first()
    assert (row.added, row.removed, row.unchanged) == (["service"], ["timestamp"], ["event_id"])
    path = str(tmp_path / "registry")
    reg.save_registry(current, path, "key")
    assert spark.read.text(path).first()[0].startswith("enc:")
    reg.save_registry(reg.schema_publish(reg.load_registry(spark, path, "key"), proposed), path, "key")
    assert [tuple(r) for r in reg.load_registry(spark, path, "key").collect()] == [("v1", "v1", ["event_id", "service"])]


def test_projection(events):
    docs = parse_events(events('{"event_id":"evt","http":{"status":"200"},"t":null,"l":[1,{"a":"b"}]}', '{"http":{"status":"x"}}'))
    rows = typed_projection(docs, {"event_id": "event_id", "status": "http.status", "l": "l"}, {"http.status": "INTEGER"}).collect()
    assert [(r.event_id, r.status, r.l, r.cast_error) for r in rows] == [
        ("evt", 200, '[1,{"a":"b"}]', None), (None, None, None, "cast_failed:status")]
    line = docs.select(project_encoded(F.col("doc"), {"t": "t", "x": "x", "e": "event_id"})).first()[0]
    assert line == '{"e":"evt","t":null}\n'
    for bad in ({"a-b": "x"}, {"raw": "x"}, {"a": "x..y"}):
        with pytest.raises(ValueError):
            typed_projection(docs, bad)


def test_levels_and_tenants(spark, events):
    levels = spark.createDataFrame([(v,) for v in (" WARNING", "Fatal", "odd", None)], "l string")
    assert [r[0] for r in levels.select(parse_level(F.col("l"))).collect()] == ["warn", "fatal", "info", "info"]
    docs = parse_events(events('{"tenant_id":"a"}', '{"tenant":{"id":"b"}}', "{}", '{"tenant_id":"","tenant":{"id":""}}', '{"tenant_id":5}'))
    assert [r[0] for r in docs.orderBy("n").select(extract_tenant(F.col("doc"))).collect()] == ["a", "b", None, None, None]


def test_encryption(events):
    rows = events("plain", "ü" * 500).withColumn("sealed", encrypt_column(F.col("raw"), "k"))
    assert [r[0] for r in rows.select(decrypt_column(F.col("sealed"), "k")).collect()] == ["plain", "ü" * 500]
    assert rows.select(decrypt_column(F.col("raw"), "k")).first()[0] == "plain"
    with pytest.raises(Exception, match="too short"):
        events("enc:AAAA").select(decrypt_column(F.col("raw"), "k")).collect()


def test_pii_audit(events):
    rows = events('{"user":{"email":"e"},"authorization":"Bearer secret-token-value"}', "", "broken")
    found = [tuple(r) for r in pii_audit(rows, ("email", "authorization")).collect()]
    assert found == [("authorization", "confidential", 1), ("authorization", "restricted", 1), ("user.email", "restricted", 1)]


def stored(spark, path, count=240):
    """A partitioned table: one event per hour and three tenants."""
    rows = spark.range(count).select(
        F.concat(F.lit("evt"), "id").alias("event_id"), F.concat(F.lit("t"), F.col("id") % 3).alias("tenant_id"),
        F.timestamp_micros(F.lit(int(START.timestamp()) * 1_000_000) + F.col("id") * 3_600_000_000).alias("timestamp"),
        F.concat(F.lit('{"context":[{"user_id":"u'), F.col("id") % 7, F.lit('"}]}')).alias("raw"))
    tables.write_events_table(rows, path, written=F.col("timestamp"))


def test_rewrite_and_retention(spark, tmp_path):
    path, audit = str(tmp_path / "t"), str(tmp_path / "audit")
    stored(spark, path)
    assert rewrite_without(spark, path, F.col("tenant_id") == "t1", "by_tenant", "request", audit) == 80
    rows = spark.read.parquet(path)
    assert {r.tenant_id: r["count"] for r in rows.groupBy("tenant_id").count().collect()} == {"t0": 80, "t2": 80}
    assert rewrite_without(spark, path, F.col("event_id") == "nothing", "by_event_id") == 0
    now = START + timedelta(days=10)
    assert rewrite_without(spark, path, older_than("timestamp", now, 5), "by_age") == 80
    assert spark.read.parquet(path).count() == 80
    assert [(r.type, r.deleted, r.reason) for r in spark.read.parquet(audit).collect()] == [("by_tenant", 80, "request")]


def test_rewrite_by_keys_and_to_the_last_row(spark, tmp_path):
    path = str(tmp_path / "t")
    stored(spark, path)
    before = set(spark.read.parquet(path).inputFiles())
    keys = spark.createDataFrame([("evt3", "t0"), ("evt4", "t0"), ("evt5", "t2"), ("evt5", "t2"), (None, "t1")], "event_id string, tenant_id string")
    assert rewrite_without(spark, path, keys, "by_key") == 2
    left = spark.read.parquet(path)
    assert left.where(F.col("event_id").isin("evt3", "evt5")).isEmpty() and left.count() == 238
    # Files without a doomed row are the same as before.
    assert len(before - set(left.inputFiles())) == 2
    assert rewrite_without(spark, path, F.lit(True), "all") == 238
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(path).columns == left.columns
    assert rewrite_without(spark, path, F.lit(True), "all") == 0


@pytest.mark.parametrize("step", ["move", "delete", "plan"])
def test_a_lost_job_is_completed(spark, tmp_path, monkeypatch, step):
    path, audit = str(tmp_path / "t"), str(tmp_path / "audit")
    rows = spark.range(240).select(F.concat(F.lit("evt"), "id").alias("event_id"),
                                   F.timestamp_seconds(F.lit(int(START.timestamp())) + F.col("id") * 360).alias("timestamp"))
    for _ in range(2):
        tables.write_events_table(rows.coalesce(1), path, written=F.col("timestamp"))
    steps = []

    def lost(real):
        def call(self, *names):
            steps.append(names)
            # The first move puts the plan in place.
            if len(steps) > {"move": 5, "delete": 4, "plan": 0}[step]:
                raise KeyboardInterrupt
            return real(self, *names)
        return call

    name = "delete" if step == "delete" else "move"
    with monkeypatch.context() as patch:
        patch.setattr(rewrite.Files, name, lost(getattr(rewrite.Files, name)))
        with pytest.raises(KeyboardInterrupt):
            rewrite_without(spark, path, F.col("event_id").isin(*(f"evt{n}" for n in range(0, 240, 3))), "by_tenant", "", audit)
    readable = {r[0] for r in spark.read.parquet(path).select("event_id").collect()}
    assert {f"evt{n}" for n in range(240) if n % 3} <= readable
    decided = step != "plan"
    assert len(finish_rewrites(spark, path)) == decided
    rows = [r[0] for r in spark.read.parquet(path).select("event_id").collect()]
    want = [f"evt{n}" for n in range(240) if n % 3 or not decided] * 2
    assert sorted(rows) == sorted(want)
    assert finish_rewrites(spark, path) == []
    if decided:
        assert [r.deleted for r in spark.read.parquet(audit).collect()] == [160]


def test_retention_reads_only_the_hour_on_the_edge(spark, tmp_path):
    path, audit = str(tmp_path / "t"), str(tmp_path / "audit")
    stored(spark, path)
    rewrite.file_summaries(spark, path).count()

    def spoil(*hours):
        for hour in hours:
            at = START + timedelta(hours=hour)
            for file in (tmp_path / "t" / f"date={at:%Y-%m-%d}" / f"hour={at:%H}").glob("*.parquet"):
                file.write_bytes(b"not to be read")
                (file.parent / f".{file.name}.crc").unlink(missing_ok=True)

    # Neither expired files nor later ones are opened; Spark takes the schema from one of the others.
    spoil(7, 40, 119, 150)
    now = START + timedelta(days=10, minutes=30)
    assert retain_age_table(spark, path, "timestamp", now, 5, audit) == 121
    assert len(spark.read.parquet(path).inputFiles()) in (119, 120)
    spoil(170, 239)
    sizes = rewrite.file_summaries(spark, path).agg(F.sum("bytes"), F.sum("rows")).first()
    assert sizes[1] == 119
    assert retain_size_table(spark, path, "timestamp", ("event_id",), sizes[0] // 119 * 20, audit) >= 98
    assert retain_size_table(spark, path, "timestamp", ("event_id",), sizes[0]) == 0
    assert sorted((r.type, r.reason) for r in spark.read.parquet(audit).collect()) == [("by_age", "retention"), ("by_size", "retention")]


def test_retention_by_size_cuts_inside_an_hour(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(300).select(F.concat(F.lit("e"), "id").alias("event_id"), F.lit("x" * 10).alias("raw"),
                                   F.timestamp_seconds(F.lit(int(START.timestamp())) + F.floor(F.col("id") / 3) * 60).alias("timestamp"))
    tables.write_events_table(rows, path, written=F.col("timestamp"))
    assert retain_size_table(spark, path, "timestamp", ("event_id",), 1000) == 200
    left = spark.read.parquet(path)
    assert left.count() == 100 and left.where("timestamp < timestamp'2024-01-01 01:06:00'").count() == 0
    assert retain_size_table(spark, path, "timestamp", ("event_id",), 1000) == 0
    assert retain_size_table(spark, path, "timestamp", ("event_id",), 15) == 99


def test_retention_by_size_with_equal_times(spark):
    rows = spark.range(1000).select("id", F.timestamp_seconds(F.when(F.col("id") < 900, 0).otherwise(F.col("id"))).alias("ts"),
                                    F.lit("x" * 10).alias("raw"))
    kept = retain_by_size(rows, "ts", ("id",), 4000)
    assert kept.count() == 400 and kept.where("id >= 900").count() == 100
    assert retain_by_size(rows, "ts", ("id",), 10_000).count() == 1000


def test_delete_by_nested_user(spark, tmp_path):
    path = str(tmp_path / "t")
    stored(spark, path, 70)
    assert user_rows(spark.read.parquet(path), "u3", ("event_id",)).count() == 10


def test_export_is_incremental(spark, tmp_path):
    path, out = str(tmp_path / "t"), str(tmp_path / "out")
    stored(spark, path, 48)
    for _ in range(2):
        tables.export_parquet(spark, path, out, "my.events", START + timedelta(hours=3), START + timedelta(hours=30))
    rows = spark.read.parquet(out)
    assert rows.count() == 27 and {r.table for r in rows.select("table").distinct().collect()} == {"my_events"}


def test_layout(spark):
    assert layout.clean_segment("analytics\\wide.events") == "analytics_wide_events"
    assert layout.clean_segment(" ") == "events" and layout.clean_prefix("\\a/b/") == "a/b/"
    at = F.lit("2026-03-09 14:05:06.123456").cast("timestamp")
    key = spark.range(1).select(layout.archive_key(at, F.lit(7), "archive/raw", "events")).first()[0]
    assert key == "archive/raw/dataset=events/date=2026-03-09/hour=14/part-7.ndjson"


def test_archive(spark, events, tmp_path):
    tables.write_archive(events('{"a":1}', '{"b":2}'), str(tmp_path), "raw", written=F.lit("2024-01-01 05:00:00").cast("timestamp"),
                         passphrase="k", lines_per_file=1)
    lines = spark.read.text(str(tmp_path / "raw/dataset=events/date=2024-01-01/hour=05"))
    assert sorted(r[0] for r in lines.select(decrypt_column(F.col("value"), "k")).collect()) == ['{"a":1}', '{"b":2}']


def test_dead_letter_file(spark, events, tmp_path):
    path = str(tmp_path / "dlq")
    failed = events('{"a":1}', '{"b":2}').withColumn("first_error", F.lit("down"))
    dlq_records(failed, F.lit("2024-01-01 00:00:00").cast("timestamp")).write.json(path)
    spark.createDataFrame([("not json",)], "value string").write.mode("append").text(path)
    rows = read_dlq(spark, path)
    listed = {r.raw_event: r for r in rows.collect()}
    assert set(listed) == {'{"a":1}', '{"b":2}', "not json"} and listed["not json"].error == "dlq_record_invalid_json"
    wanted = listed['{"a":1}'].dlq_id
    assert dlq_show(rows, wanted).count() == 1
    dlq_delete(path, rows, spark.createDataFrame([(wanted,)], "id string"))
    after = read_dlq(spark, path).collect()
    assert {r.raw_event for r in after} == {'{"b":2}', "not json"}
    assert {r.dlq_id for r in after} < {r.dlq_id for r in listed.values()}


def test_backlog(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "spool.ndjson").write_text('not-json\n{"event":"a"}\n\n')
    for _ in range(2):
        good = replay_backlog(spark, str(tmp_path / "in"), str(tmp_path / "bad"))
    assert [r.raw for r in good.collect()] == ['{"event":"a"}']
    assert [(r.raw, r.reason) for r in spark.read.json(str(tmp_path / "bad")).collect()] == [("not-json", "invalid_spool_record")]


def test_otlp(spark):
    body = {"resourceLogs": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "checkout"}}]}, "scopeLogs": [
        {"logRecords": [
            {"timeUnixNano": "1700000000000000001", "body": {"stringValue": "order.created"}, "severityText": " WARN "},
            {"observed_time_unix_nano": "1700000000500000000", "body": {"doubleValue": 2.50}, "attributes": [
                {"key": "service.name", "value": {"intValue": "9007199254740993"}}, {"key": "e"},
                {"key": "l", "value": {"arrayValue": {"values": [{"bytesValue": "aGk="}, {"kvlistValue": {"values": [
                    {"key": "k", "value": {"boolValue": True}}]}}]}}}]},
        ]}]}]}
    rows = flatten_otlp_logs(spark.createDataFrame([(json.dumps(body),)], "payload string"), OtlpSettings()).collect()
    first, second = sorted((json.loads(r.raw) for r in rows), key=lambda e: e["event"], reverse=True)
    assert (first["service"], first["event"], first["level"], first["event_id"], first["timestamp"]) == (
        "checkout", "order.created", "warn", "otlp_1700000000000000001", "2023-11-14T22:13:20.000000001Z")
    assert (second["event"], second["event_id"], second["timestamp"]) == ("2.5", "otlp_0", "2023-11-14T22:13:20.5Z")
    assert second["attrs"] == {"service.name": 9007199254740993, "e": "", "l": ["hi", {"k": True}]}


def test_otlp_bad_values(spark):
    def export(n, value):
        return (n, json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [
            {"attributes": [{"key": "ok", "value": {"intValue": "1"}}]}, {"attributes": [{"key": "v", "value": value}]}]}]}]}))

    values = [{"arrayValue": {"values": [{"intValue": "abc"}]}}, {"arrayValue": {"values": None}}, {"bytesValue": "a"},
              {"arrayValue": [1]}]
    df = spark.createDataFrame([export(n, v) for n, v in enumerate(values)], "n int, payload string")
    rows = flatten_otlp_logs(df, keep=("n",)).collect()
    assert len(rows) == 8 and sorted(r.n for r in rows if r.raw is None) == [0, 2, 3]
    assert [json.loads(r.raw)["attrs"] for r in rows if r.n == 1 and '"v"' in r.raw] == [{"v": []}]
    errors = otlp_errors(df, keep=("n",)).orderBy("n").collect()
    assert [r.n for r in errors] == [0, 2, 3] and all(r.error and '"v"' in r.record for r in errors)


def test_options_and_payloads(spark, events):
    assert queue_options([" a:1", "b:2"], "t", "g")["kafka.bootstrap.servers"] == "a:1,b:2"
    assert queue_options(["a"], "t", "g")["startingOffsets"] == "earliest"
    assert external.kafka_rows(events("x")).columns == ["value"]
    assert external.postgres_options("jdbc:x", "t", batch_size=5)["batchsize"] == "5"
    assert push_payloads.clean_labels({" app ": " x ", "1bad": "y"}) == {"app": "x"}
    bodies = push_payloads.loki_batches(events(*map(str, range(250))), {"app": "x"}, size=100).collect()
    assert sum(b.lines for b in bodies) == 250 and max(b.lines for b in bodies) <= 100
    assert json.loads(bodies[0].payload)["streams"][0]["stream"] == {"app": "x"}


def test_push_bodies_are_bounded_and_repeatable(events):
    texts = ['say "é"\n', " ", "x" * 500, *(f"line {n}" for n in range(40)), "y" * 90]
    at = F.lit(START).cast("timestamp")
    made = push_payloads.loki_batches(events(*texts), {}, at, size=7, max_bytes=300)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString().replace("Coalesce", "")
    bodies = made.collect()
    values = [v for b in bodies for v in json.loads(b.payload)["streams"][0]["values"]]
    assert sorted(line for _, line in values) == sorted(t.strip() for t in texts if t.strip())
    assert {t for t, _ in values} == {str(int(START.timestamp()) * 10**9)}
    assert all(b.lines <= 7 and (len(b.payload.encode()) <= 300 or b.lines == 1) for b in bodies)
    assert [b.batch_id for b in made.collect()] == [b.batch_id for b in bodies] and len({b.batch_id for b in bodies}) == len(bodies)


def test_read_only_sql(spark, events):
    assert is_read_only(" SELECT 1") and is_read_only("with a as (select 1) select * from a")
    assert not any(map(is_read_only, ("", "drop table t", "select 1; drop table t")))
    with pytest.raises(ValueError):
        run_query(spark, "delete from t", {})
    result = query_result(run_query(spark, "select n, raw from stored order by n", {"stored": events(*"abc")}, limit=2))
    assert result == {"columns": ["n", "raw"], "rows": [{"n": 0, "raw": "a"}, {"n": 1, "raw": "b"}], "row_count": 2, "truncated": False}
    assert query_result(events(*"abc"), limit=2)["truncated"] and query_result(events(*"abc"), limit=3)["row_count"] == 3
    assert run_query(spark, "select * from range(1500)", {}).count() == 1500
