"""Hiding sensitive members.

Two steps exist.  The collector step compares member names in normal form and scans string members
for secrets.  The processor step compares names, paths and wildcards, or redacts everything outside
an allowlist.  Both change the text of an event inside its row: no explode, no shuffle, no rebuild.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from eventloom.config import Limits, Privacy
from eventloom.functions import jsontext as jt
from eventloom.functions import sensitive, tokens
from eventloom.operators.nodes import is_text, json_nodes
from eventloom.operators.settle import settle

_MASK_TOKEN = json.dumps(sensitive.MASK)


def collector_mask(privacy: Privacy, raw: Column, text: Column, limits: Limits) -> tuple[Column, Column, Column]:
    """Three columns: may ``raw`` need work, does ``text`` (compact JSON) need it, and the masked text."""
    if not privacy.collector_active:
        return F.lit(False), F.lit(False), text
    key = sensitive.blocked_key_token(privacy.blocklist)
    names = sorted({sensitive.normal_name(n) for n in privacy.blocklist})

    def hidden(plain: Column, name: Column, value: Column) -> Column:
        secret = is_text(value) & sensitive.secret_match(jt.unquote(value)) if privacy.secret_scan else F.lit(False)
        return sensitive.normal_key(name).isin(*names) | secret if names else secret

    return _mask(privacy.blocklist, key, privacy.secret_scan, raw, text, limits, hidden)


Rule = Callable[[Column, Column, Column], Column]
PlainRule = Callable[[str, str], bool]


def _mask(names: tuple[str, ...], key: str | None, scan: bool, raw: Column, text: Column,
          limits: Limits, hidden: Rule, plain: PlainRule | None = None) -> tuple[Column, Column, Column]:
    bounded = limits.enabled and 0 < limits.max_attr_depth <= jt.MAX_PATTERN_DEPTH
    levels = limits.max_attr_depth if bounded else jt.MAX_PATTERN_DEPTH
    pattern = sensitive.mask_pattern(key, scan, levels)
    hint = sensitive.raw_text_hint(raw, names, key, scan)
    hit = text.rlike(pattern)
    masked = F.regexp_replace(text, pattern, sensitive.mask_replacement(key, scan))
    if bounded:
        return hint, hit, masked
    # Nesting beyond the pattern: the same rule, token by token.
    too_deep = (jt.occurrences(text, "{[") > levels) & (jt.max_depth(text) > levels)
    walked = tokens.mask_members(F.when(too_deep, text), hidden, _MASK_TOKEN, plain)
    return hint, F.when(too_deep, F.size(walked["paths"]) > 0).otherwise(hit), F.when(
        too_deep, walked["raw"]).otherwise(masked)


def wildcard(pattern: str) -> str:
    """``user.*`` as a regular expression over lower-case paths."""
    return "".join(".*" if c == "*" else re.escape(c) for c in pattern.lower())


def match_pattern(plain: Column, key: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a member matches: by key, by full path, by last dotted part, or by wildcard."""
    path, name = F.lower(plain), F.lower(key)
    exact = [p.lower() for p in patterns]
    stars = [wildcard(p) for p in patterns if "*" in p]
    last = F.substring_index(path, ".", -1)
    found = name.isin(*exact) | path.isin(*exact) | last.isin(*exact) if exact else F.lit(False)
    return found | path.rlike(f"(?s)^(?:{'|'.join(stars)})$") if stars else found


def _place_rule(privacy: Privacy) -> Rule:
    """Outside an allowlist, or else in the blocklist, by name, path, last part or wildcard."""
    def hidden(plain: Column, name: Column, value: Column) -> Column:
        if privacy.allowlist:
            return ~match_pattern(plain, name, privacy.allowlist)
        return match_pattern(plain, name, privacy.blocklist)

    return hidden


def _plain_rule(privacy: Privacy) -> PlainRule:
    """``_place_rule`` in a task, for ASCII names without an escape: lower case is the same there."""
    patterns = privacy.allowlist or privacy.blocklist
    exact, stars = {p.lower() for p in patterns}, [wildcard(p) for p in patterns if "*" in p]
    # As in the JVM, the end may be before a last line break.
    star = re.compile(rf"(?s:{'|'.join(stars)})(?:\r\n|[\n\r])?").fullmatch if stars else None

    def hidden(path: str, name: str) -> bool:
        path = path.lower()
        found = name.lower() in exact or path in exact or path.rpartition(".")[2] in exact or bool(star and star(path))
        return found != bool(privacy.allowlist)

    return hidden


def redact_processor(df: DataFrame, privacy: Privacy, limits: Limits = Limits()) -> DataFrame:
    """Masks ``raw`` by allowlist or blocklist; expects ``doc`` and gives back both.

    Plain member names are matched by a pattern.  Paths, wildcards and allowlists need the position in the document and are
    matched token by token; masked values are spliced into the text as it came, so numbers and all other bytes stay.  For a
    blocklist, only rows whose text mentions the last name of a pattern are looked at.
    """
    if not privacy.processor_active or not (privacy.allowlist or privacy.blocklist):
        return df
    raw, doc = F.col("raw"), F.col("doc")
    by_place = bool(privacy.allowlist) or any("." in p or "*" in p for p in privacy.blocklist)
    if by_place:
        may_match = F.lit(True) if privacy.allowlist else _mentions(raw, privacy.blocklist)
        looked_at = F.when(doc.isNotNull() & may_match, raw)
        walked = settle(df.withColumn("_walk", tokens.mask_members(
            looked_at, _place_rule(privacy), _MASK_TOKEN, _plain_rule(privacy))), "_walk")
        out = walked.withColumn("_masked", F.when(F.size("_walk.paths") > 0, F.col("_walk.raw"))).drop("_walk")
    else:
        key = sensitive.named_key_token(privacy.blocklist)
        hint, hit, masked = _mask(privacy.blocklist, key, False, raw, F.col("_text"), limits, _place_rule(privacy), _plain_rule(privacy))
        out = (
            df.withColumn("_text", F.when(doc.isNotNull() & hint, F.to_json(doc)))
            .withColumn("_masked", F.when(hit, masked)).drop("_text")
        )
    masked_rows = (
        out.withColumn("doc", F.when(F.col("_masked").isNotNull(), F.try_parse_json("_masked")).otherwise(doc))
        .withColumn("raw", F.coalesce("_masked", "raw")).drop("_masked")
    )
    return settle(masked_rows, "raw", "doc")


def _mentions(raw: Column, patterns: tuple[str, ...]) -> Column:
    """FALSE only where no pattern can match: no last name of one occurs in the text."""
    tails = [p.rsplit(".", 1)[-1] for p in patterns]
    if any("*" in t or not t.isascii() for t in tails):
        return F.lit(True)
    return raw.rlike(r"\\|(?iu:" + "|".join(re.escape(t) for t in tails) + ")")


def redaction_audit(df: DataFrame, privacy: Privacy, keep: tuple[str, ...]) -> DataFrame:
    """One row ``(keep..., message, field)`` per member of ``raw`` the processor step hides."""
    def paths_of(text: Column) -> Column:
        return tokens.mask_members(text, _place_rule(privacy), _MASK_TOKEN, _plain_rule(privacy))["paths"]

    found = settle(df.select(*keep, "raw", paths_of(F.col("raw")).alias("_paths")), "_paths")
    # Only where a path comes twice, an object may repeat a key; its last value counts.
    twice = F.size(F.array_distinct("_paths")) < F.size("_paths")
    single = F.when(twice, tokens.without_repeats(F.col("raw"), F.try_parse_json("raw")))
    return found.select(*keep, F.lit("pii_redacted").alias("message"), F.explode(F.coalesce(paths_of(single), "_paths")).alias("field"))


def privacy_verdict(failed: Column, mode: str) -> Column:
    """``invalid`` where a redaction failure must stop an event, else ``pass``."""
    return F.when(failed & F.lit(mode.lower() == "enforce"), "invalid").otherwise("pass")


def pii_audit(
    df: DataFrame, blocklist: tuple[str, ...], keep: tuple[str, ...] = (), limit: int | None = None,
    secret: str = sensitive.SECRET,
) -> DataFrame:
    """Rows ``(path, classification, count)`` over the events in ``raw``.

    Only events whose text shows a blocked name, a secret or an escape are taken apart.  Without
    ``limit`` the whole table is read; with it, that many rows, as a quick look.
    """
    rows = df.limit(limit) if limit else df
    names = sorted({sensitive.normal_name(n) for n in blocklist})
    key = sensitive.blocked_key_token(blocklist)
    if secret == sensitive.SECRET:
        hint = sensitive.raw_text_hint(F.col("raw"), blocklist, key, True)
    else:
        hint = F.contains("raw", F.lit("\\")) | F.col("raw").rlike(sensitive.raw_text_pattern(key, True, secret))
    valid = jt.strict_json(jt.trim(F.col("raw"))).isNotNull()
    marked = settle(rows.where(hint).withColumn("raw", F.when(valid, F.col("raw"))), "raw")
    nodes = json_nodes(marked, keep=keep).where(F.col("key").isNotNull())
    text = F.when(is_text(F.col("value")), jt.unquote(F.col("value")))
    classes = F.array_compact(F.array(
        F.when(sensitive.normal_key(F.col("key")).isin(*names), F.lit("restricted")),
        F.when(text.rlike(secret), F.lit("confidential")),
    ))
    return (
        nodes.select("path", F.explode(classes).alias("classification"))
        .groupBy("path", "classification").agg(F.count("*").alias("count"))
        .orderBy("path", "classification")
    )

