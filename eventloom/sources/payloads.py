"""Request bodies: arrays, envelopes, single objects and NDJSON."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventloom.config import RequestLimits
from eventloom.functions import jsontext as jt
from eventloom.functions import tokens
from eventloom.functions.paths import elements
from eventloom.operators.settle import settle

_VALUE = jt.value(jt.MAX_PATTERN_DEPTH)
_ITEM = rf"\G[\s,]*+({_VALUE})"
_MEMBER = rf"\G[\s,]*+({jt.STRING})\s*:\s*({_VALUE})"

# Accepted content types, and the response status of each request error.
CONTENT_TYPES = ("application/json", "application/x-ndjson", "application/ndjson")
REQUEST_ERRORS = {
    "unsupported_content_type": 415,
    "payload_too_large": 413,
    "invalid_request_payload": 400,
    "empty_event_payload": 400,
    "max_events_exceeded": 413,
}


def split_ndjson(payload: Column) -> Column:
    """Trimmed lines, blank ones dropped."""
    return F.filter(F.transform(F.split(payload, "\n"), jt.trim), lambda line: line != "")


def _inside(text: Column) -> Column:
    return F.substring(text, F.lit(2), F.length(text) - 2)


def array_texts(text: Column, parsed: Column) -> Column:
    """The elements of a JSON array, each as it is written.

    Should an element nest deeper than the pattern reaches, the tokens of the text are read one by one instead.
    """
    written = F.regexp_extract_all(_inside(text), F.lit(_ITEM), F.lit(1))
    return tokens.let(written, lambda found: F.when(F.size(found) == F.size(elements(parsed)), found).otherwise(
        tokens.children(text)["value"]))


def _last_member(text: Column, name: str) -> Column:
    """The text of the last top-level member with that name, in any case."""
    keys = F.regexp_extract_all(_inside(text), F.lit(_MEMBER), F.lit(1))
    values = F.regexp_extract_all(_inside(text), F.lit(_MEMBER), F.lit(2))

    def named(found: Column) -> Column:
        pairs = F.zip_with(found, values, lambda key, value: F.when(F.lower(key) == f'"{name}"', value))
        # The pattern ends at a value that nests deeper than it reaches; then the tokens are read one by one.
        walked = F.transform(tokens.children(text), lambda c: F.when(F.lower(c["key"]) == name, c["value"]))
        return F.when(F.size(F.array_distinct(found)) < F.size(F.json_object_keys(text)), walked).otherwise(pairs)

    return F.try_element_at(F.array_compact(tokens.let(keys, named)), F.lit(-1))


def _may_be(doc: Column, path: str, kind: str) -> Column:
    """Absent, null or of the given kind."""
    found = F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    return F.coalesce((found == "VOID") | F.startswith(found, F.lit(kind)), F.lit(True))


def parse_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``items``, the texts of the events; NULL where the body is not valid."""
    body = F.col("_body")
    first = F.substring(body, 1, 1)
    envelope = _may_be(F.col("_doc"), "$.api_version", "STRING") & _may_be(F.col("_doc"), "$.source", "OBJECT")
    for name in ("sdk", "version", "service"):
        envelope &= _may_be(F.col("_doc"), f"$.source.{name}", "STRING")
    lines = split_ndjson(body)
    listed = F.col("_doc").isNotNull() & (first == "{") & envelope & F.contains(F.lower(body), F.lit('"events"'))
    parsed = (
        df.withColumn("_body", jt.trim(F.col(payload)))
        .withColumn("_pair", F.when(first.isin("[", "{"), jt.closed_pair(body)))
        .withColumn("_doc", jt.value_of_pair(F.col("_pair"), body))
        .withColumn("_listed", F.when(listed, _last_member(body, "events")))
        .withColumn("_listed", F.when(F.startswith("_listed", F.lit("[")), F.col("_listed")))
        .withColumn("_events", F.when(F.col("_listed").isNotNull(),
                                      array_texts(F.col("_listed"), F.try_parse_json("_listed"))))
    )
    several = F.when(F.contains(body, F.lit("\n")) & (F.size(lines) > 1), lines)
    items = (
        F.when(body == "", F.array().cast("array<string>"))
        .when((first == "[") & F.col("_doc").isNotNull(), array_texts(body, F.col("_doc")))
        .when(first == "[", F.lit(None))
        .when((first == "{") & F.col("_doc").isNull(), several)
        .when(first == "{", F.when(F.size("_events") > 0, F.col("_events")).otherwise(F.array(body)))
        .otherwise(lines)
    )
    listed_items = parsed.withColumn("items", items).drop("_body", "_pair", "_doc", "_listed", "_events")
    return settle(listed_items, "items")


def request_guards(df: DataFrame, limits: RequestLimits = RequestLimits(), payload: str = "payload") -> DataFrame:
    """Adds ``items``, ``request_error`` and ``http_status`` (NULL for good requests).

    Checks in order: content type (a column ``content_type``, if there is one), body size (also a column ``too_large``),
    syntax, number of events.  Counting the items needs no shuffle.
    """
    too_large = F.octet_length(payload) > limits.max_body_bytes
    if "too_large" in df.columns:
        too_large = F.coalesce("too_large", F.lit(False)) | too_large
    parsed = parse_payloads(df.withColumn("_kept", F.when(~too_large, F.col(payload))), "_kept").drop("_kept")
    kind = F.lower(F.trim(F.split_part(F.coalesce(F.col("content_type"), F.lit("")), F.lit(";"), F.lit(1)))) \
        if "content_type" in df.columns else F.lit("")
    count = F.size("items")
    error = (
        F.when((kind != "") & ~kind.isin(*CONTENT_TYPES), "unsupported_content_type")
        .when(too_large, "payload_too_large")
        .when(F.col("items").isNull(), "invalid_request_payload")
        .when(count == 0, "empty_event_payload")
        .when(count > limits.max_events, "max_events_exceeded")
    )
    statuses = F.create_map(*(F.lit(x) for pair in REQUEST_ERRORS.items() for x in pair))
    return parsed.withColumn("request_error", error).withColumn("http_status", statuses[F.col("request_error")])


def explode_payloads(df: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """``(keep..., index, raw)``, one row per event of a valid body; ``request_guards`` tells about the others."""
    parsed = df if "items" in df.columns else parse_payloads(df, payload)
    return parsed.select(*keep, F.posexplode("items").alias("index", "raw"))


def read_ndjson(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """NDJSON files as ``raw``, one row per line; Spark splits large files."""
    reader = spark.readStream if stream else spark.read
    lines = reader.text(path)
    return lines.select(jt.trim(F.col("value")).alias("raw")).where(F.col("raw") != "")


def read_payload_files(spark: SparkSession, path: str, limits: RequestLimits = RequestLimits()) -> DataFrame:
    """One request per file: ``(request_id, payload, too_large)``; see ``decode_bodies``."""
    files = spark.read.format("binaryFile").load(path)
    return decode_bodies(files.select(F.col("path").alias("request_id"), "content"), limits)


def decode_bodies(bodies: DataFrame, limits: RequestLimits = RequestLimits()) -> DataFrame:
    """``(request_id, payload, too_large)`` of request bodies ``(request_id, content)``.

    The name tells the encoding: ``.gz`` is gzip and ``.zst`` zstd, of one or several members or frames; others are taken as they
    are.  A body over the limit is decoded no further; it has no payload, and ``request_guards`` refuses it.  A body that is
    damaged, or ends inside a member or frame, has no payload either and is not too large.
    """
    try:
        import zstandard  # noqa: F401
    except ImportError as missing:
        raise RuntimeError("reading compressed request bodies needs the zstandard package") from missing
    most = limits.max_body_bytes

    @F.pandas_udf("payload string, too_large boolean")
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            decoded = [_decoded(name, body, most) for name, body in zip(batch["request_id"], batch["content"])]
            yield pd.DataFrame(decoded, columns=["payload", "too_large"])

    return bodies.select("request_id", decode(F.struct("request_id", "content")).alias("_body")).select(
        "request_id", "_body.payload", "_body.too_large")


def _decoded(name: str, body: bytes, most: int) -> tuple[str | None, bool]:
    import gzip
    import io

    import zstandard

    stream = io.BytesIO(body)
    if name.endswith(".gz"):
        stream = gzip.GzipFile(fileobj=stream)
    elif name.endswith(".zst"):
        stream = zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True)
    try:
        content = stream.read(most + 1)
        if len(content) <= most and name.endswith(".zst"):
            _check_frames(body)
    except (OSError, EOFError, zlib.error, zstandard.ZstdError):
        return None, False
    return (None, True) if len(content) > most else (content.decode("utf-8", "replace"), False)


def _check_frames(body: bytes) -> None:
    """Raises EOFError if a zstd body ends inside a frame: its stream reader would give out what is there as if it were all."""
    import zstandard

    while body:
        frame = zstandard.ZstdDecompressor().decompressobj()
        frame.decompress(body)
        if not frame.eof:
            raise EOFError("zstd frame not finished")
        body = frame.unused_data


def read_unpacked_batches(df: DataFrame, events: str = "events", keep: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """Events of ``(batch_id, events ARRAY<STRUCT<raw_json>>)``; null and empty ones are skipped."""
    rows = df.select(*keep, F.posexplode(events).alias("index", "event"))
    texts = rows.select(*keep, "index", F.col("event.raw_json").cast("string").alias("raw"))
    return texts.where(F.coalesce(F.col("raw"), F.lit("")) != "")
