"""OTLP log exports (JSON form) as wide events."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from eventloom.functions.jsontext import is_blank, strict_json, trim
from eventloom.functions.paths import elements, is_json_string, members


@dataclass(frozen=True)
class OtlpSettings:
    schema_version: str = "v1"
    event_version: str = "v1"
    default_service: str = ""
    # Adds a hash of the record to the event id, so that records without a time stay apart.
    unique_ids: bool = False


def pick(node: Column, camel: str) -> Column:
    """A member by its JSON name or by its original field name."""
    snake = "".join("_" + c.lower() if c.isupper() else c for c in camel)
    found = F.try_variant_get(node, f"$.{camel}", "variant")
    return found if snake == camel else F.coalesce(found, F.try_variant_get(node, f"$.{snake}", "variant"))


def _nested(value: Column) -> Column:
    parts = [pick(value, n) for n in ("arrayValue", "kvlistValue", "bytesValue")]
    return F.coalesce(*parts)


def any_value(value: Column) -> Column:
    """The plain value of a scalar AnyValue as VARIANT; no value is the empty text."""
    number = pick(value, "intValue")
    double = pick(value, "doubleValue")
    return (
        F.when(pick(value, "stringValue").isNotNull(), pick(value, "stringValue"))
        .when(pick(value, "boolValue").isNotNull(), pick(value, "boolValue"))
        .when(number.isNotNull(), F.try_variant_get(number, "$", "bigint").cast("variant"))
        .when(double.isNotNull(), F.try_variant_get(double, "$", "double").cast("variant"))
        .otherwise(F.lit("").cast("variant"))
    )


# What stands before the message where a value cannot be decoded; no JSON text starts like it.
_BAD = "!"


def _decoded(text: str | None, plain: Callable) -> str | None:
    """Plain JSON of an encoded value; a bad value gives a marked message and leaves the other rows alone."""
    try:
        return None if text is None else json.dumps(plain(json.loads(text)), ensure_ascii=False)
    except (ValueError, TypeError, AttributeError, RecursionError) as failure:
        return f"{_BAD}{type(failure).__name__}: {failure}"


def _error_of(decoded: str) -> Column:
    return F.when(F.startswith(F.col(decoded), F.lit(_BAD)), F.substring(decoded, 2, 500))


@F.pandas_udf(StringType())
def decode_nested(texts: pd.Series) -> pd.Series:
    """Lists, key-value lists and bytes of any depth as plain JSON; NULL passes through."""
    return texts.map(lambda t: _decoded(t, _plain))


def _plain(value: dict):
    def field(camel: str, snake: str):
        return value.get(camel, value.get(snake))

    if (items := field("arrayValue", "array_value")) is not None:
        return [_plain(v) for v in items.get("values") or []]
    if (pairs := field("kvlistValue", "kvlist_value")) is not None:
        return {p.get("key", ""): _plain(p.get("value") or {}) for p in pairs.get("values") or []}
    if (blob := field("bytesValue", "bytes_value")) is not None:
        return base64.b64decode(blob).decode("utf-8", "replace")
    if (number := field("intValue", "int_value")) is not None:
        return int(number)
    for names in (("stringValue", "string_value"), ("boolValue", "bool_value"), ("doubleValue", "double_value")):
        if (scalar := field(*names)) is not None:
            return scalar
    return ""


def _pairs(attributes: Column) -> Column:
    """``ARRAY<STRUCT<key, value>>`` of an attribute list with scalar values."""
    return F.transform(
        F.coalesce(elements(attributes), F.array().cast("array<variant>")),
        lambda a: F.struct(F.coalesce(F.try_variant_get(a, "$.key", "string"), F.lit("")).alias("key"),
                           any_value(F.try_variant_get(a, "$.value", "variant")).alias("value")),
    )


def kv_merge(base: Column, record: Column) -> Column:
    """Attributes as a map; the last of equal keys wins, and the record wins over the resource."""
    return F.map_from_entries(F.concat(base, record))


@F.pandas_udf(StringType())
def _plain_attributes(texts: pd.Series) -> pd.Series:
    def pairs(attributes):
        return {a.get("key", ""): _plain(a.get("value") or {}) for a in attributes}

    return texts.map(lambda t: _decoded(t, pairs))


def attributes_of(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds ``name``: the attribute list in ``column`` as ``ARRAY<STRUCT<key, value>>``; ``name_error`` is why it cannot be.

    Lists with nested values or bytes go through Arrow; all others stay in the JVM.
    """
    text = F.to_json(F.col(column))
    nested = text.rlike('"(?:arrayValue|array_value|kvlistValue|kvlist_value|bytesValue|bytes_value)":')
    decoded = df.withColumn("_flat", _plain_attributes(F.when(nested, text)))
    flat = F.transform(F.map_entries(members(F.try_parse_json("_flat"))),
                       lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    decoded = decoded.withColumn(f"{name}_error", _error_of("_flat"))
    return decoded.withColumn(name, F.coalesce(flat, _pairs(F.col(column)))).drop("_flat")


def event_time(primary: Column, observed: Column) -> Column:
    """Nanoseconds of the first time that is set, else of the processing time."""
    return F.coalesce(F.nullif(primary, F.lit(0).cast("bigint")), F.nullif(observed, F.lit(0).cast("bigint")),
                      F.unix_micros(F.current_timestamp()) * 1000)


def event_name(body: Column, decoded: Column) -> Column:
    """Non-blank text, a number or a truth value as the event name; else ``otlp.log``."""
    text = pick(body, "stringValue").cast("string")
    raw_bytes = F.when(pick(body, "bytesValue").isNotNull(), F.try_parse_json(decoded).cast("string"))
    words = F.coalesce(text, raw_bytes)
    number = F.coalesce(F.try_variant_get(pick(body, "intValue"), "$", "bigint").cast("string"),
                        _decimal_text(F.try_variant_get(pick(body, "doubleValue"), "$", "double")),
                        F.try_variant_get(pick(body, "boolValue"), "$", "boolean").cast("string"))
    return F.coalesce(F.when(~is_blank(words), words), number, F.lit("otlp.log"))


def _decimal_text(number: Column) -> Column:
    """A double as the shortest plain decimal: no exponent, no trailing ``.0``."""
    plain = F.regexp_replace(number.cast("decimal(38,17)").cast("string"), r"\.?0+$", "")
    return F.when(F.abs(number) < 1e15, plain).when(number.isNotNull(), F.format_string("%.0f", number))


def flatten_otlp_logs(df: DataFrame, settings: OtlpSettings = OtlpSettings(), payload: str = "payload",
                      keep: tuple[str, ...] = ()) -> DataFrame:
    """One wide event (``raw``) per log record of the exports in ``payload``.

    Three explodes in one stage; the payload is parsed once and nothing is shuffled.  A record with a value that
    cannot be decoded has a NULL ``raw``, which governance refuses; ``otlp_errors`` has its text.
    """
    return _events(_records(df, payload, keep), settings, keep)


def otlp_errors(df: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(keep..., record, error)`` of every log record with a value that cannot be decoded."""
    bad = _records(df, payload, keep).where(F.col("_error").isNotNull())
    return bad.select(*keep, F.to_json("_l").alias("record"), F.col("_error").alias("error"))


def _records(df: DataFrame, payload: str, keep: tuple[str, ...]) -> DataFrame:
    none = F.array().cast("array<variant>")

    def each(node: Column, name: str) -> Column:
        return F.explode(F.coalesce(elements(pick(node, name)), none))

    resources = df.select(*keep, each(strict_json(trim(F.col(payload))), "resourceLogs").alias("_r"))
    scopes = resources.withColumn("_ra", F.try_variant_get("_r", "$.resource.attributes", "variant"))
    scopes = attributes_of(scopes, "_ra", "_base").withColumn("_s", each(F.col("_r"), "scopeLogs"))
    records = scopes.select(*keep, "_base", "_base_error", each(F.col("_s"), "logRecords").alias("_l"))
    records = attributes_of(
        records.withColumn("_la", F.try_variant_get("_l", "$.attributes", "variant")), "_la", "_own")
    body = F.try_variant_get("_l", "$.body", "variant")
    records = records.withColumn("_body", decode_nested(F.when(_nested(body).isNotNull(), F.to_json(body))))
    return records.withColumn("_error", F.coalesce("_base_error", "_own_error", _error_of("_body")))


def _events(records: DataFrame, settings: OtlpSettings, keep: tuple[str, ...]) -> DataFrame:
    body = F.try_variant_get("_l", "$.body", "variant")

    def nanos(name: str) -> Column:
        return F.coalesce(F.try_variant_get(pick(F.col("_l"), name), "$", "bigint"), F.lit(0).cast("bigint"))

    def base_text(name: str) -> Column:
        value = F.try_element_at(F.map_from_entries("_base"), F.lit(name))
        return F.when(is_json_string(value), trim(value.cast("string")))

    primary, at = nanos("timeUnixNano"), event_time(nanos("timeUnixNano"), nanos("observedTimeUnixNano"))
    event_id = F.concat(F.lit("otlp_"), primary.cast("string"))
    if settings.unique_ids:
        event_id = F.concat(event_id, F.lit("_"), F.substring(F.sha2(F.to_json("_l"), 256), 1, 16))
    named = [F.when(~is_blank(base_text("service.name")), base_text("service.name"))]
    if settings.default_service.strip():
        named.append(F.lit(settings.default_service))
    environment = F.nullif(base_text("deployment.environment"), F.lit(""))
    events = records.select(
        *keep,
        F.struct(
            F.lit(settings.schema_version).alias("schema_version"),
            F.lit(settings.event_version).alias("event_version"),
            nanos_text(at).alias("timestamp"),
            event_id.alias("event_id"),
            F.coalesce(*named, F.lit("otlp")).alias("service"),
            event_name(body, F.col("_body")).alias("event"),
            F.lit("log").alias("kind"),
            F.coalesce(F.lower(trim(pick(F.col("_l"), "severityText").cast("string"))), F.lit("")).alias("level"),
            kv_merge(F.col("_base"), F.col("_own")).alias("attrs"),
            F.struct(F.lit("otlp").alias("sdk")).alias("source"),
            F.when(environment.isNotNull(), F.struct(environment.alias("environment"))).alias("deployment"),
        ).alias("_event"),
        at.alias("time_unix_nano"), "_error",
    )
    return events.select(*keep, "time_unix_nano", F.when(F.col("_error").isNull(), F.to_json("_event")).alias("raw"))


def nanos_text(nanos: Column) -> Column:
    """RFC 3339 in UTC with nanoseconds, trailing zeros of the fraction dropped."""
    fraction = F.pmod(nanos, F.lit(1_000_000_000).cast("bigint"))
    seconds = F.timestamp_seconds(((nanos - fraction) / F.lit(1_000_000_000)).cast("bigint"))
    digits = F.rtrim(F.lpad(fraction.cast("string"), 9, "0"), F.lit("0"))
    dotted = F.when(digits == "", F.lit("")).otherwise(F.concat(F.lit("."), digits))
    return F.concat(F.date_format(seconds, "yyyy-MM-dd'T'HH:mm:ss"), dotted, F.lit("Z"))
