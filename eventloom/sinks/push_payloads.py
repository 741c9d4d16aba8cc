"""Bodies for push APIs, as tables.  Sending them over HTTP is left to the caller."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from eventloom.functions.jsontext import trim
from eventloom.operators.projection import parse_level

# Label names that are accepted, and severity numbers of the OTLP log model.
LABEL_NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")
SEVERITY_NUMBERS = {"debug": 5, "info": 9, "warn": 13, "error": 17, "fatal": 21}

def clean_labels(labels: Mapping[str, str]) -> dict[str, str]:
    """Labels with a valid name, both sides trimmed."""
    return {k.strip(): v.strip() for k, v in labels.items() if LABEL_NAME.fullmatch(k.strip())}


def loki_batches(df: DataFrame, labels: Mapping[str, str], at: Column | None = None, size: int = 100,
                 max_bytes: int = 1_000_000) -> DataFrame:
    """``(batch_id, lines, payload)``: push bodies of one stream with at most ``size`` lines and ``max_bytes`` bytes.

    Rows stay in their partitions: a task fills bodies one after the other as its rows pass, and holds one.  A line that is over the
    bytes on its own makes a body of its own.  The id is a hash of the body, so a retry over the same rows gives the same ids.
    """
    time = at if at is not None else F.current_timestamp()
    nanos, line = (F.unix_micros(time) * 1000).cast("string"), trim(F.col("raw"))
    entries = df.select(nanos.alias("t"), line.alias("line")).where(F.col("line") != "").select(
        F.to_json(F.array("t", "line")).alias("entry"))
    named = clean_labels(labels)
    stream = f'"stream":{json.dumps(named, ensure_ascii=False, separators=(',', ':'), sort_keys=True)},' if named else ""
    head, tail = f'{{"streams":[{{{stream}"values":['.encode(), b"]}]}"

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, used = [], 0

        def body() -> pa.RecordBatch:
            payload = head + b",".join(held) + tail
            return pa.RecordBatch.from_arrays(
                [pa.array([hashlib.sha256(payload).hexdigest()[:32]]), pa.array([len(held)], pa.int32()),
                 pa.array([payload], pa.binary()).cast(pa.string())], names=["batch_id", "lines", "payload"])

        for batch in batches:
            for entry in batch.column(0).cast(pa.binary()).to_pylist():
                if held and (len(held) == size or used + len(entry) + 1 > max_bytes):
                    yield body()
                    held.clear()
                if not held:
                    used = len(head) + len(tail) - 1
                held.append(entry)
                used += len(entry) + 1
        if held:
            yield body()

    return entries.mapInArrow(fill, "batch_id string, lines int, payload string")


def otlp_records(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """OTLP-JSON log records of canonical events that also carry ``raw``."""

    def text(value: Column) -> Column:
        return F.struct(value.alias("stringValue"))

    attributes = F.array(*(
        F.struct(F.lit(n).alias("key"), text(F.coalesce(F.col(n), F.lit(""))).alias("value"))
        for n in ("event_id", "request_id", "service", "outcome")))
    number = F.create_map(*(F.lit(x) for pair in SEVERITY_NUMBERS.items() for x in pair))
    nanos = (F.unix_micros("timestamp") * 1000).cast("string")
    body = trim(F.col("raw"))
    record = F.struct(
        nanos.alias("timeUnixNano"),
        number[parse_level(F.col("level"))].alias("severityNumber"),
        text(body).alias("body"),
        F.coalesce(F.col("event"), F.lit("")).alias("eventName"),
        attributes.alias("attributes"),
    )
    return events.where(body != "").select(*keep, record.alias("record"), F.to_json(record).alias("json"))
