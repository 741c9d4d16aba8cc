"""Checks and rewrites of single events: one narrow plan, one parse per event.

Columns in: ``raw``.  Columns out: ``raw`` (rewritten where a step changed it), ``doc``, ``code`` and
``message`` (NULL for events that pass) and ``event_id``.  Rows never leave; a failing event keeps
its first code, and its text stays as it came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from eventloom.config import Contract, Identity, Limits, Privacy, Settings
from eventloom.functions import jsontext as jt
from eventloom.functions import tokens
from eventloom.functions.paths import members, string_at
from eventloom.operators.redaction import collector_mask
from eventloom.operators.settle import settle

# Spark parses JSON up to this nesting.
PARSED_LEVELS = 1000

_UNPARSED = f"event nests deeper than can be parsed (> {PARSED_LEVELS})"


def parse_events(df: DataFrame) -> DataFrame:
    """Trims ``raw`` and adds ``doc``: the object as VARIANT, NULL unless the text is one JSON object."""
    # Trimming lists every byte; a text from brace to brace has nothing to trim.
    bare = F.startswith("raw", F.lit("{")) & F.endswith("raw", F.lit("}"))
    parsed = (
        df.withColumn("raw", F.when(bare, F.col("raw")).otherwise(jt.trim(F.col("raw"))))
        .withColumn("_pair", F.when(F.startswith("raw", F.lit("{")), jt.closed_pair(F.col("raw"))))
        .withColumn("doc", jt.value_of_pair(F.col("_pair"), F.col("raw")))
        .drop("_pair")
    )
    return settle(parsed, "raw", "doc")


def is_json_object(raw: Column, doc: Column) -> Column:
    """Whether an event is one JSON object, also where it nests deeper than can be parsed."""
    return doc.isNotNull() | F.coalesce(beyond_parsing(raw, doc)["valid"], F.lit(False))


def beyond_parsing(raw: Column, doc: Column) -> Column:
    """``struct(valid, fields, depth)`` of an object text that nests so deep that it has no ``doc``; else NULL."""
    deep = doc.isNull() & F.startswith(raw, F.lit("{")) & (jt.occurrences(raw, "{[") >= PARSED_LEVELS)
    return tokens.check(F.when(deep, raw))


def contract_code(doc: Column, contract: Contract) -> Column:
    """A version that is a non-empty string must be the expected one; a missing version passes."""
    schema, event = string_at(doc, "schema_version"), string_at(doc, "event_version")
    return F.when(
        (schema != "") & (schema != contract.schema_version), "unsupported_schema_version"
    ).when((event != "") & (event != contract.event_version), "unsupported_event_version")


def measure(df: DataFrame, limits: Limits) -> DataFrame:
    """Adds ``n_fields``, ``depth`` and ``long_string``, exact where a limit may be passed.

    Counting colons, brackets and bytes of the raw text bounds all three from above; only events
    over such a bound are measured, the others get NULL.  An object that nests too deep to be parsed is
    measured on its tokens; ``unparsed`` says that it is one.
    """
    raw, doc, size = F.col("raw"), F.col("doc"), F.octet_length("raw")
    sized = (size <= limits.max_event_bytes) if limits.max_event_bytes else F.lit(True)
    # A member takes at least five bytes with its comma, so a short text cannot have too many.
    many = (size > 4 * limits.max_attr_count) & (jt.occurrences(raw, ":") > limits.max_attr_count)
    deep = jt.occurrences(raw, "{[") + 1 > limits.max_attr_depth
    # An escape shortens a string, never lengthens it, so the raw text is at least as long.
    long = size > limits.max_string_length

    def flag(limit: int, suspect: Column) -> Column:
        return sized & suspect if limits.enabled and limit else F.lit(False)

    flags = df.withColumns({
        "_many": flag(limits.max_attr_count, many),
        "_deep": flag(limits.max_attr_depth, deep),
        "_long": flag(limits.max_string_length, long),
    })
    many, deep, long, text = F.col("_many"), F.col("_deep"), F.col("_long"), F.col("_compact")
    within = F.coalesce(F.col("n_fields") <= limits.max_attr_count, F.lit(True)) & F.coalesce(
        F.col("depth") <= limits.max_attr_depth, F.lit(True))
    too_long = within & long & jt.has_long_string(text, limits.max_string_length)
    return (
        flags.withColumn("_compact", F.when(many | deep | long, F.to_json(doc)))
        .withColumn("_beyond", beyond_parsing(raw, doc))
        .withColumn("unparsed", F.coalesce(F.col("_beyond.valid"), F.lit(False)))
        .withColumns({
            "n_fields": F.when(F.col("unparsed") & many, F.col("_beyond.fields")).when(many, jt.field_count(text)),
            "depth": F.when(F.col("unparsed") & sized, F.col("_beyond.depth")).when(deep, jt.max_depth(text))})
        .withColumn("long_string", F.when(too_long, jt.first_long_string(text, limits.max_string_length)))
        .drop("_compact", "_many", "_deep", "_long", "_beyond")
    )


def limit_finding(limits: Limits) -> Column:
    """``struct(code, message)`` of the first limit passed, from the columns of ``measure``."""
    size, count, depth = F.octet_length("raw"), F.col("n_fields"), F.col("depth")
    text = F.col("long_string")

    def finding(code: str, message: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), message.alias("message"))

    def over(what: str, value: Column, limit: int) -> Column:
        return F.concat(F.lit(f"{what} ("), value.cast("string"), F.lit(f" > {limit})"))

    none = F.lit(None).cast("struct<code: string, message: string>")
    if not limits.enabled:
        return none
    found = F.when(F.lit(False), none)
    if limits.max_event_bytes:
        found = found.when(size > limits.max_event_bytes, finding(
            "event_too_large", over("event exceeds max_event_bytes", size, limits.max_event_bytes)))
    return (
        found.when(count > limits.max_attr_count, finding(
            "attr_count_exceeded", over("event field count exceeds max_attr_count", count, limits.max_attr_count)))
        .when(depth > limits.max_attr_depth, finding(
            "attr_depth_exceeded", over("event depth exceeds max_attr_depth", depth, limits.max_attr_depth)))
        .when(text.isNotNull(), finding(
            "string_too_long",
            F.concat(F.lit("field "), text["path"], F.lit(" exceeds max_string_length ("),
                     text["bytes"].cast("string"), F.lit(f" > {limits.max_string_length})"))))
    )


def apply_limits(df: DataFrame, limits: Limits) -> DataFrame:
    """Adds ``code`` and ``message`` for the size, count, depth and string limits."""
    judged = F.col("doc").isNotNull() | F.col("unparsed")
    found = measure(df, limits).withColumn("_found", F.when(judged, limit_finding(limits)))
    coded = found.withColumn("code", F.col("_found.code")).withColumn("message", F.col("_found.message"))
    return settle(coded.drop("_found", "unparsed"), "n_fields", "depth", "long_string", "code", "message")


def alias_change(doc: Column) -> Column:
    """``drop`` (event_type is redundant), ``move`` (event_type becomes event) or NULL."""
    event, alias = string_at(doc, "event"), string_at(doc, "event_type")
    has_event = F.coalesce(~jt.is_blank(event), F.lit(False))
    has_alias_key = F.try_variant_get(doc, "$.event_type", "variant").isNotNull()
    return F.when(has_event & has_alias_key, "drop").when(~has_event & ~jt.is_blank(alias), "move")


def normalize_aliases(doc: Column, change: Column) -> Column:
    """The members of ``doc`` with ``event_type`` folded into ``event``."""
    fields = members(doc)
    rest = F.map_filter(fields, lambda k, _: k != "event_type")
    moved = F.map_concat(
        F.map_filter(rest, lambda k, _: k != "event"), F.create_map(F.lit("event"), fields["event_type"])
    )
    return F.when(change == "drop", rest).when(change == "move", moved).otherwise(fields)


def stamp_identity(fields: Column, identity: Identity) -> Column:
    """Overwrites the identity members of an event with the bound ones."""

    def text(value: str) -> Column:
        return F.lit(value).cast("variant")

    def as_object(updates: dict[str, Column]) -> Column:
        pairs = [part for name, value in updates.items() for part in (F.lit(name), value)]
        return F.create_map(*pairs)

    def merged(key: str, updates: dict[str, str]) -> Column:
        update = as_object({k: text(v) for k, v in updates.items()})
        present = members(F.element_at(fields, F.lit(key)))
        kept = F.map_filter(present, lambda k, _: ~k.isin(*updates))
        return F.to_variant_object(F.coalesce(F.map_concat(kept, update), update))

    stamped: dict[str, Column] = {}
    if identity.service_name:
        stamped["service"] = text(identity.service_name)
        names = {"name": identity.service_name, "version": identity.service_version}
        stamped["service_identity"] = merged("service_identity", {k: v for k, v in names.items() if v})
    places = {"environment": identity.environment, "region": identity.region}
    if any(places.values()):
        stamped["deployment"] = merged("deployment", {k: v for k, v in places.items() if v})
    if identity.tenant_id:
        stamped["tenant"] = merged("tenant", {"id": identity.tenant_id})
    for key, bound in (("workspace", identity.workspace_id), ("organization", identity.organization_id)):
        if bound:
            stamped[key] = F.to_variant_object(as_object({"id": text(bound)}))
    if not stamped:
        return fields
    return F.map_concat(F.map_filter(fields, lambda k, _: ~k.isin(*stamped)), as_object(stamped))


def rewrite_events(df: DataFrame, settings: Settings) -> DataFrame:
    """Alias, identity and redaction on events without a ``code``; unchanged events keep their bytes."""
    identity, privacy = settings.identity, settings.privacy
    doc, good = F.col("doc"), F.col("code").isNull() & F.col("doc").isNotNull()
    change = F.col("_alias")
    df = df.withColumn("_alias", F.when(good, alias_change(doc)))
    stamped = good if identity.stamps else F.lit(False)
    fields = normalize_aliases(doc, change)
    fields = stamp_identity(fields, identity) if identity.stamps else fields
    df = df.withColumn("_changed", change.isNotNull() | stamped)
    df = df.withColumn("_edited", F.when(F.col("_changed"), F.to_variant_object(fields)).when(good, doc))
    hint, hit, masked = collector_mask(privacy, F.col("raw"), F.col("_text"), settings.limits)
    df = df.withColumn("_text", F.when(F.col("_changed") | (good & hint), F.to_json(F.col("_edited"))))
    df = df.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    df = df.withColumn("_new", F.when(F.col("_hit"), masked).when(F.col("_changed"), F.col("_text")))
    return df.drop("_alias", "_changed", "_edited", "_text", "_hit")


def _adopt_rewrites(df: DataFrame, limits: Limits) -> DataFrame:
    """Takes over rewritten texts, unless a rewritten event is too large."""
    new_size, limit = F.octet_length("_new"), limits.max_event_bytes
    too_large = (new_size > limit) if limits.enabled and limit else F.lit(False)
    too_large = F.coalesce(too_large, F.lit(False))
    message = F.concat(F.lit("event exceeds max_event_bytes after collector governance ("),
                       new_size.cast("string"), F.lit(f" > {limit})"))
    taken = F.col("_new").isNotNull() & ~too_large
    return (
        df.withColumn("message", F.when(too_large, message).otherwise(F.col("message")))
        .withColumn("code", F.when(too_large, "event_too_large_after_governance").otherwise(F.col("code")))
        .withColumn("doc", F.when(taken, F.try_parse_json("_new")).otherwise(F.col("doc")))
        .withColumn("raw", F.when(taken, F.col("_new")).otherwise(F.col("raw")))
        .drop("_new")
    )


def govern(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Object check, contract, limits, aliases, identity, redaction and the size check after it.

    An object that nests deeper than can be parsed gets the code of the limit it passes; without such a limit it is refused for its
    depth all the same, as no later step could read it.  The contract cannot be looked up in it.
    """
    events = parse_events(df)
    doc = F.col("doc")
    contract = contract_code(doc, settings.contract) if settings.contract.enabled else F.lit(None).cast("string")
    events = (
        measure(events, settings.limits)
        .withColumn("event_id", string_at(doc, "event_id"))
        .withColumn("_contract", contract)
        .withColumn("_limit", limit_finding(settings.limits))
        .withColumn("code", F.when(doc.isNull() & ~F.col("unparsed"), "expected_json_object")
                    .otherwise(F.coalesce("_contract", "_limit.code", F.when(doc.isNull(), "attr_depth_exceeded"))))
        .withColumn("message", F.when(doc.isNull() & ~F.col("unparsed"), "event payload must be a JSON object")
                    .otherwise(F.coalesce("_contract", "_limit.message", F.when(doc.isNull(), _UNPARSED))))
        .drop("_contract", "_limit", "n_fields", "depth", "long_string", "unparsed")
    )
    governed = _adopt_rewrites(rewrite_events(events, settings), settings.limits)
    return settle(governed, "raw", "doc", "event_id", "code", "message")


def redact_events(df: DataFrame, privacy: Privacy, limits: Limits = Limits()) -> DataFrame:
    """Only the redaction step of ``govern``."""
    neutral = Settings(privacy=privacy, limits=limits, identity=Identity(enabled=False))
    events = parse_events(df).withColumn("code", F.lit(None).cast("string"))
    hint, hit, masked = collector_mask(privacy, F.col("raw"), F.col("_text"), neutral.limits)
    return (
        events.withColumn("_text", F.when(hint & F.col("doc").isNotNull(), F.to_json("doc")))
        .withColumn("raw", F.when(hit, masked).otherwise(F.col("raw")))
        .drop("_text", "code")
    )
