"""Schema registry: version defaults, required fields, modes, diff and publish."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventloom.config import RegistryEntry, SchemaRules
from eventloom.functions.crypto import decrypt_column, encrypt_column
from eventloom.functions.jsontext import trim
from eventloom.functions.paths import members, string_at
from eventloom.operators.joins import lookup_join
from eventloom.operators.settle import settle
from eventloom.session import cut_lineage, scratch_path

REGISTRY_SCHEMA = "schema_version string, event_version string, required_fields array<string>"
_STRICT_MODES = ("reject", "enforce", "quarantine")
_VERSIONS = ["schema_version", "event_version"]
BROADCAST_ENTRIES = 10_000


def registry_table(spark: SparkSession, entries: Iterable[RegistryEntry]) -> DataFrame:
    """Configured entries as a table; of entries for the same versions the first counts."""
    first: dict[tuple[str, str], list[str]] = {}
    for entry in entries:
        first.setdefault((entry.schema_version, entry.event_version), list(entry.required_fields))
    return spark.createDataFrame([(*versions, fields) for versions, fields in first.items()], REGISTRY_SCHEMA)


def with_versions(df: DataFrame, rules: SchemaRules) -> DataFrame:
    """Adds ``schema_version`` and ``event_version``; an empty or non-string one takes the configured value."""
    doc = F.col("doc")
    for name, default in (("schema_version", rules.schema_version), ("event_version", rules.event_version)):
        found = F.coalesce(string_at(doc, name), F.lit(""))
        df = df.withColumn(name, F.when(found == "", F.lit(default)).otherwise(found))
    return df


def apply_version_defaults(df: DataFrame, rules: SchemaRules) -> DataFrame:
    """Writes the configured versions into events that lack them; other events keep their bytes."""
    doc = F.col("doc")
    wanted = {"schema_version": rules.schema_version, "event_version": rules.event_version}
    missing = {name: F.coalesce(string_at(doc, name), F.lit("")) == "" for name, value in wanted.items() if value}
    if not missing:
        return df
    lacking = F.array_compact(F.array(*(F.when(absent, F.lit(name)) for name, absent in missing.items())))
    defaults = F.create_map(*(
        part for name in missing for part in (F.lit(name), F.lit(wanted[name]).cast("variant"))))
    df = df.withColumn("_lacking", F.when(doc.isNotNull(), lacking))
    fields = F.map_concat(
        F.map_filter(members(doc), lambda k, _: ~F.array_contains(F.col("_lacking"), k)),
        F.map_filter(defaults, lambda k, _: F.array_contains(F.col("_lacking"), k)),
    )
    df = df.withColumn("doc", F.when(F.size("_lacking") > 0, F.to_variant_object(fields)).otherwise(doc))
    return df.withColumn("raw", F.when(F.size("_lacking") > 0, F.to_json("doc")).otherwise(F.col("raw"))).drop(
        "_lacking")


def check_required_fields(df: DataFrame, registry: DataFrame, rules: SchemaRules) -> DataFrame:
    """Adds ``schema_error``: NULL, a missing field, or (strict modes) an unknown version pair.

    The first required name that is not a top-level key counts; a null value is present.
    """
    versions = with_versions(df, rules)
    entries = first_entries(registry)
    # One job: a registry is a configuration, so its entries nearly always fit the plan itself.
    listed = entries.limit(BROADCAST_ENTRIES + 1).collect()
    has_entries = bool(listed)
    if len(listed) <= BROADCAST_ENTRIES:
        known = df.sparkSession.createDataFrame(listed, entries.schema).withColumn("_known", F.lit(True))
        joined = versions.join(F.broadcast(known), _VERSIONS, "left")
    else:
        joined = lookup_join(versions, cut_lineage(entries).withColumn("_known", F.lit(True)), _VERSIONS)
    missing = F.when(F.col("_known"), F.get(F.array_except(
        "required_fields", F.array_union(F.json_object_keys("raw"), _defaulted(rules))), F.lit(0)))
    error = F.when(missing.isNotNull(), F.concat(
        F.lit('schema validation: missing required field "'), missing, F.lit('"')))
    if has_entries and rules.mode.lower() in _STRICT_MODES:
        error = error.when(F.col("_known").isNull(), F.concat(
            F.lit("schema validation: unknown schema/event version combination ("),
            F.col("schema_version"), F.lit("/"), F.col("event_version"), F.lit(")")))
    return joined.withColumn("schema_error", F.when(F.col("doc").isNotNull(), error)).drop(
        "_known", "required_fields")


def _defaulted(rules: SchemaRules) -> Column:
    """Keys that version defaults put into every event."""
    names = [n for n, v in zip(_VERSIONS, (rules.schema_version, rules.event_version)) if v]
    return F.array(*map(F.lit, names)).cast("array<string>")


def schema_route(error: Column, mode: str) -> Column:
    """``pass``, ``warn`` (kept unmodified), ``invalid`` or ``quarantine``."""
    failing = {"warn": "warn", "reject": "invalid", "enforce": "invalid", "quarantine": "quarantine"}
    return F.when(error.isNotNull(), failing.get(mode.lower(), "pass")).otherwise("pass")


def check_schema(df: DataFrame, registry: DataFrame, rules: SchemaRules) -> DataFrame:
    """Adds ``schema_error`` and ``schema_route``; passing events get their version defaults."""
    if rules.mode.lower() in ("", "off"):
        none = df.withColumn("schema_error", F.lit(None).cast("string"))
        return none.withColumn("schema_route", F.lit("pass"))
    checked = check_required_fields(df, registry, rules)
    checked = checked.withColumn("schema_route", schema_route(F.col("schema_error"), rules.mode))
    checked = settle(checked, "schema_error", "schema_route")
    filled = apply_version_defaults(
        checked.withColumn("_raw", F.col("raw")).withColumn("_doc", F.col("doc")), rules)
    passes = F.col("schema_route") == "pass"
    return (
        filled.withColumn("raw", F.when(passes, F.col("raw")).otherwise(F.col("_raw")))
        .withColumn("doc", F.when(passes, F.col("doc")).otherwise(F.col("_doc")))
        .drop("_raw", "_doc", "schema_version", "event_version")
    )


def normalize_fields(fields: Column) -> Column:
    """Trimmed, without blanks and repeats, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(fields, trim), lambda name: name != "")))


def schema_diff(current: DataFrame, proposed: DataFrame) -> DataFrame:
    """Per version pair: fields added, removed and unchanged between two registries."""
    none = F.array().cast("array<string>")
    new = proposed.select(*(trim(F.col(c)).alias(c) for c in _VERSIONS),
                          normalize_fields(F.col("required_fields")).alias("proposed"))
    old = current.select(*_VERSIONS, F.col("required_fields").alias("current"))
    both = old.join(new, _VERSIONS, "full").withColumns(
        {"current": F.coalesce("current", none), "proposed": F.coalesce("proposed", none)})
    return both.select(
        *_VERSIONS, "current", "proposed",
        F.array_except("proposed", "current").alias("added"),
        F.array_except("current", "proposed").alias("removed"),
        F.array_intersect("proposed", "current").alias("unchanged"),
    )


def schema_publish(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """Upsert by version pair.  Entries without both versions are refused by ``published_entries``."""
    new = published_entries(entries)
    return registry.join(new.select(*_VERSIONS), _VERSIONS, "left_anti").unionByName(new)


def published_entries(entries: DataFrame) -> DataFrame:
    clean = entries.select(*(trim(F.col(c)).alias(c) for c in _VERSIONS),
                           normalize_fields(F.col("required_fields")).alias("required_fields"))
    return first_entries(clean.where((F.col("schema_version") != "") & (F.col("event_version") != "")))


def first_entries(entries: DataFrame) -> DataFrame:
    """One entry per version pair; a repeated one would multiply the events it matches.

    A column ``place`` says which comes first.  Without one, rows have no order that a repartition would keep, so the entry with the
    least list of fields counts.
    """
    fields = F.col("required_fields")
    first = F.min_by(fields, F.struct("place", "required_fields")) if "place" in entries.columns else F.min(fields)
    return entries.groupBy(*_VERSIONS).agg(first.alias("required_fields"))


def save_registry(registry: DataFrame, path: str, passphrase: str = "") -> None:
    """One JSON text per entry, encrypted if a passphrase is given.

    The new snapshot is written in full before it replaces the old one, as it may be derived from it.
    """
    line = encrypt_column(F.to_json(F.struct(*REGISTRY_COLUMNS)), passphrase).alias("value")
    staged = scratch_path(registry.sparkSession, "registry")
    registry.select(line).write.text(staged)
    registry.sparkSession.read.text(staged).coalesce(1).write.mode("overwrite").text(path)


def load_registry(spark: SparkSession, path: str, passphrase: str = "") -> DataFrame:
    """The saved entries; of entries for the same versions, the first line counts."""
    line = decrypt_column(F.col("value"), passphrase)
    entry = F.from_json(line, REGISTRY_SCHEMA)
    # Lines are numbered as they are read: by file, then by place in the file.
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return first_entries(spark.read.text(path).select(entry.alias("entry"), place.alias("place")).select("entry.*", "place"))


REGISTRY_COLUMNS = (*_VERSIONS, "required_fields")


def failure_records(df: DataFrame, error: str, at: Column | None = None) -> DataFrame:
    """``(timestamp, error, raw)`` rows as kept in the quarantine and dead-letter tables."""
    when = at if at is not None else F.current_timestamp()
    stamp = F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return df.select(stamp.alias("timestamp"), F.col(error).alias("error"), "raw")


def quarantine_records(checked: DataFrame, at: Column | None = None) -> DataFrame:
    held = checked.where(F.col("schema_route") == "quarantine")
    return failure_records(held.withColumn(
        "_error", F.coalesce("schema_error", F.lit("schema_validation_failed"))), "_error", at)
