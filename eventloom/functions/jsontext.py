"""Measuring JSON in its text form, inside the JVM and inside one row.

Field count, nesting depth and string length are properties of the token stream, so a regular
expression over the compact text gives them without exploding the document: no extra rows, no
shuffle, and rows that pass a cheap bound on the raw text never get that far.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Pieces of JSON text.  Every loop is possessive: JSON tokens never need backtracking, and the JVM
# runs possessive loops without recursion, so a string of any length is safe.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
ATOM = r'[^\s{}\[\],:"]++'

# A container pattern is written out once per nesting level; deeper values take another way.
MAX_PATTERN_DEPTH = 64

# Whitespace that is trimmed around text: Unicode White_Space.
SPACES = (" \t\n\u000b\f\r\u0085  " + "".join(map(chr, range(0x2000, 0x200B)))
          + "    　")

_END = "␄ end of event"


def container(levels: int) -> str:
    """Pattern of one object or array that nests at most ``levels`` deep."""
    inside = rf'[^"\[\]{{}}]++|{STRING}'
    pattern = rf"[\[{{](?:{inside})*+[\]}}]"
    for _ in range(levels - 1):
        pattern = rf"[\[{{](?:{inside}|{pattern})*+[\]}}]"
    return pattern


def value(levels: int) -> str:
    return f"(?:{STRING}|{container(levels)}|{ATOM})"


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return trim(text) == ""


def closed_pair(text: Column) -> Column:
    """``[text, end mark]`` as VARIANT.

    ``try_parse_json`` stops after the first complete value and ignores what follows.  With a mark
    behind the text, anything but exactly one value moves or hides the mark.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), _mark(text), F.lit('"]')))


def _mark(text: Column) -> Column:
    taken = F.contains(text, F.lit(_END))
    return F.when(taken, F.concat(F.lit(_END), F.md5(text))).otherwise(F.lit(_END))


def value_of_pair(pair: Column, text: Column) -> Column:
    whole = (F.try_variant_get(pair, "$[1]", "string") == _mark(text)) & F.try_variant_get(
        pair, "$[2]", "variant"
    ).isNull()
    return F.when(whole, F.try_variant_get(pair, "$[0]", "variant"))


def strict_json(text: Column) -> Column:
    """The text as VARIANT, or NULL unless the whole text is one JSON value."""
    return value_of_pair(closed_pair(text), text)


def occurrences(text: Column, characters: str) -> Column:
    """How often any of some one-byte characters occurs."""
    size = F.octet_length(text)
    counts = [size - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in characters]
    return sum(counts[1:], counts[0])


def field_count(compact: Column) -> Column:
    """Number of object members at every depth.  ``compact`` holds each key once per object."""
    return occurrences(F.regexp_replace(compact, STRING, ""), ":")


def outline(compact: Column) -> Column:
    """``(`` and ``}`` for the begin and end of each container, and ``(}`` for all that stands between two brackets.

    A key, a scalar and a comma each stand beside a child, so a run of them is as deep as one scalar, and an event of many members
    has a short outline.
    """
    scalars_marked = F.regexp_replace(compact, rf'(?:[^"{{}}\[\]]++|{STRING})++', "<>")
    return F.translate(scalars_marked, "{[<}]>", "(((}}}")


def max_depth(compact: Column) -> Column:
    """1 for a scalar, 1 + the deepest child for a container."""
    # As many steps as ends are followed by a begin.
    steps = F.split(outline(compact), r"(?<=\})(?=\()")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(state: Column, run: Column) -> Column:
        begins, size = F.octet_length(F.rtrim(run, F.lit("}"))), F.octet_length(run)
        top = F.greatest(state["top"], state["now"] + begins)
        return F.struct((state["now"] + begins * 2 - size).alias("now"), top.alias("top"))

    return F.aggregate(steps, start, step, lambda state: state["top"])


def unquote(token: Column) -> Column:
    """The text a JSON string token stands for; only tokens with an escape are parsed."""
    escaped = F.contains(token, F.lit("\\"))
    return F.when(escaped, F.try_variant_get(F.try_parse_json(token), "$", "string")).otherwise(
        F.substring(token, F.lit(2), F.length(token) - 2))


def text_bytes(token: Column) -> Column:
    """Bytes of ``unquote(token)``; a token without an escape is only measured."""
    return F.when(F.contains(token, F.lit("\\")), F.octet_length(unquote(token))).otherwise(F.octet_length(token) - 2)


def has_long_string(compact: Column, limit: int) -> Column:
    """Whether a string value (not a key) is longer than ``limit`` bytes."""
    texts = F.regexp_extract_all(compact, F.lit(f"({STRING}:?)"), F.lit(1))
    return F.exists(
        texts,
        lambda t: (F.octet_length(t) - 2 > limit) & F.endswith(t, F.lit('"')) & (text_bytes(t) > limit),
    )


def first_long_string(compact: Column, limit: int) -> Column:
    """``struct(path, bytes)`` of the first string in path order that is over the limit.

    A fold over the tokens keeps the path of every open container; it holds as many entries as the
    document is deep, so the state stays small.
    """
    tokens = F.regexp_extract_all(compact, F.lit(rf"({STRING}:?|[{{}}\[\],]|{ATOM})"), F.lit(1))
    start = F.struct(
        F.array().cast("array<string>").alias("paths"),
        F.array().cast("array<int>").alias("slots"),
        F.lit("").alias("next"),
        F.lit(None).cast("string").alias("found"),
        F.lit(0).alias("bytes"),
    )

    def child_path(state: Column) -> Column:
        base, slot = F.element_at(state["paths"], -1), F.element_at(state["slots"], -1)
        named = F.when(base == "", state["next"]).otherwise(F.concat_ws(".", base, state["next"]))
        numbered = F.concat(base, F.lit("["), slot.cast("string"), F.lit("]"))
        return F.when(F.size(state["paths"]) == 0, F.lit("")).when(slot >= 0, numbered).otherwise(named)

    def make(paths, slots, next_key, found, size) -> Column:
        return F.struct(paths.alias("paths"), slots.alias("slots"), next_key.alias("next"),
                        found.alias("found"), size.alias("bytes"))

    def step(s: Column, token: Column) -> Column:
        first = F.substring(token, 1, 1)
        is_key = (first == '"') & F.endswith(token, F.lit(":"))
        depth = F.size(s["paths"])
        opened = make(F.concat(s["paths"], F.array(child_path(s))),
                      F.concat(s["slots"], F.array(F.when(first == "[", 0).otherwise(-1))),
                      s["next"], s["found"], s["bytes"])
        closed = make(F.slice(s["paths"], F.lit(1), depth - 1), F.slice(s["slots"], F.lit(1), depth - 1),
                      s["next"], s["found"], s["bytes"])
        slot = F.element_at(s["slots"], -1)
        moved = make(s["paths"],
                     F.when(slot >= 0, F.concat(F.slice(s["slots"], F.lit(1), depth - 1), F.array(slot + 1)))
                     .otherwise(s["slots"]),
                     s["next"], s["found"], s["bytes"])
        keyed = make(s["paths"], s["slots"], unquote(F.rtrim(token, F.lit(":"))), s["found"], s["bytes"])
        size = text_bytes(token)
        path = F.when(depth == 0, F.lit("<root>")).otherwise(child_path(s))
        better = (size > limit) & (s["found"].isNull() | (path < s["found"]))
        texted = make(s["paths"], s["slots"], s["next"], F.when(better, path).otherwise(s["found"]),
                      F.when(better, size).otherwise(s["bytes"]))
        return (
            F.when(first.isin("{", "["), opened)
            .when(first.isin("}", "]"), closed)
            .when(first == ",", moved)
            .when(is_key, keyed)
            .when((first == '"') & (F.octet_length(token) - 2 > limit), texted)
            .otherwise(s)
        )

    return F.aggregate(
        tokens, start, step,
        lambda s: F.when(s["found"].isNotNull(), F.struct(s["found"].alias("path"), s["bytes"].alias("bytes"))),
    )
