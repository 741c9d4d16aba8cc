"""A token machine over JSON text: one scan cuts the text into tokens, one fold reads them.

A token is a value or the end of a container, together with all that stands before it: white space, comma, key.  Tokens tile the
text, so a text put together again from its tokens keeps every byte that nobody replaced.  The fold keeps the open containers on
a stack, as deep as the text nests, and needs neither a parse into another form nor a bound on the depth.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, functions as F

from eventloom.functions.jsontext import ATOM, STRING, field_count, unquote

_SPACE = r"[ \t\n\r]*+"

# Groups: key with quotes, or empty; value as written, one bracket for containers.  For texts known to be valid.
_TOKEN = rf"{_SPACE}(?:,{_SPACE})?(?:({STRING}){_SPACE}:{_SPACE})?({STRING}|[{{}}\[\]]|{ATOM})"

# The same by the letter of the JSON grammar, for texts with empty strings only.  Brackets that follow each other are one piece, so a deep
# text has few.  Groups: comma, key, run of ends, run of begins with the keys between them, value or begin of an object without a key.
_EXACT_STRING = r'"(?:[^"\\\x00-\x1F]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
_EXACT_ATOM = r"true|false|null|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"
_BEGINS = rf'(?:\[{_SPACE}|\{{{_SPACE}""{_SPACE}:{_SPACE})*+'
_EXACT = (rf'{_SPACE}(,)?{_SPACE}(?:(""){_SPACE}:{_SPACE})?(?=[\[\]{{}}"tfn0-9-])'
          rf'(?:([\]}}](?:{_SPACE}[\]}}])*+)|({_BEGINS})(""|\{{|{_EXACT_ATOM})?)')

# Containers may nest so deep; a JSON decoder with this limit calls a deeper text invalid.
DEEPEST = 10_000

# The first pattern in a task; its classes are ASCII ones, as they are in the JVM.
_SCAN = re.compile(_TOKEN, re.ASCII).finditer

# The same in a task, with runs of brackets as one value; groups: all before the value, key with quotes, value.
_RUNS = re.compile(rf"({_SPACE}(?:,{_SPACE})?(?:({STRING}){_SPACE}:{_SPACE})?)({STRING}|[{{\[]++|[}}\]]++|{ATOM})", re.ASCII).findall

# Paths that are kept with what was found for them, in characters.
_KEPT_PATHS = 10_000_000

_NODE = "struct<path: string, key: string, depth: int, value: string>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once.  A fold over nothing hands it on as it is; ``transform`` would copy it."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, use)


def _fold(entries: Column, start: dict[str, Column], lot: Column, step: Callable[[Column, Column], Column],
          finish: Callable[[Column], Column]) -> Column:
    """Folds ``entries`` with a state of the fields of ``start`` and ``lot``, which collects what the fold gives out.

    ``aggregate`` copies its state at every step.  So the entries are taken in blocks, as many as a block has entries: a block
    begins with an empty lot, and only the block's result is added to those before.  ``finish`` gets the array of all lots.
    """

    def blocks(all_: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(all_)))).cast("int")
        last = F.greatest(F.lit(0), F.ceil(F.size(all_) / width).cast("int") - 1)
        return let(width, lambda w: F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(all_, i * w + 1, w)))

    def state(held: Column, name: str, collected: Column) -> Column:
        return F.struct(*(held[field].alias(field) for field in start), collected.alias(name))

    def one_block(whole: Column, block: Column) -> Column:
        return let(F.aggregate(block, state(whole, "lot", lot), step),
                   lambda made: state(made, "lots", F.concat(whole["lots"], F.array(made["lot"]))))

    empty = F.slice(F.array(lot), F.lit(1), F.lit(0))
    first = F.struct(*(value.alias(field) for field, value in start.items()), empty.alias("lots"))
    return let(entries, lambda all_: F.aggregate(blocks(all_), first, one_block, lambda s: finish(s["lots"])))


def _groups(text: Column, pattern: str, *groups: tuple[str, int]) -> Column:
    """Array of structs with the named groups of every match."""
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(number)).alias(name) for name, number in groups]
    return F.arrays_zip(*parts)


def _opens(value: Column) -> Column:
    return value.isin("{", "[")


def _closes(value: Column) -> Column:
    return value.isin("}", "]")


def without_repeats(text: Column, doc: Column) -> Column:
    """The text, or compact text of ``doc``, its parsed form, where an object of it repeats a key and the last one counts.

    Only a text with a key that occurs twice, or with an escape in a key, is looked at closely: repeats in one object show in the
    number of members that are left after parsing.
    """
    keys = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1))
    suspect = let(F.filter(keys, lambda k: k != ""),
                  lambda k: (F.size(F.array_distinct(k)) < F.size(k)) | F.exists(k, lambda x: F.contains(x, F.lit("\\"))))
    compact = F.to_json(doc)
    return F.when(suspect & (field_count(text) != field_count(compact)), compact).otherwise(text)


def _name(token: str) -> str | None:
    """``unquote`` of a key token, in a task."""
    if "\\" not in token:
        return token[1:-1]
    try:
        return json.loads(token, strict=False).encode("utf-8", "replace").decode()
    except ValueError:
        return None


def _joined(base: str, key: str | None) -> str | None:
    return key if base == "" else None if base is None or key is None else f"{base}.{key}"


def _nodes_of(text: str, containers: bool) -> Iterator[tuple[str | None, str | None, int, str | None]]:
    """``(path, key, depth, value)`` of all nodes of one text; the stack holds path, key, next index and start of open containers."""
    stack: list[list] = []
    for token in _SCAN(text):
        quoted, value = token[1], token[2]
        if value in ("}", "]"):
            path, key, _, first = stack.pop()
            yield path, key, len(stack) + 1, text[first:token.end()] if containers else None
            continue
        parent, key = stack[-1] if stack else None, None
        if quoted is not None:
            key = _name(quoted)
        if key is not None:
            path = _joined(parent[0], key)
        elif parent is not None and parent[2] >= 0:
            path = f"{parent[0]}[{parent[2]}]"
        else:
            path = ""
        if parent is not None and parent[2] >= 0:
            parent[2] += 1
        if value in ("{", "["):
            stack.append([path, key, 0 if value == "[" else -1, token.start(2)])
        else:
            yield path, key, len(stack) + 1, value


def nodes(text: Column, containers: bool = False) -> Column:
    """Array of all nodes of a valid JSON text: ``struct(path, key, depth, value)``; NULL for a NULL text.

    ``path`` carries array indexes; ``key`` is NULL for the root and for elements.  ``value`` is the text of a scalar as written,
    and of a container too where ``containers`` asks for it; else NULL.  Nodes follow their children.
    """

    def walk(texts: pa.Array) -> pa.Array:
        found = [None if t is None else list(_nodes_of(t, containers)) for t in texts.to_pylist()]
        columns = zip(*(node for one in found if one for node in one))
        kinds = (("path", pa.string()), ("key", pa.string()), ("depth", pa.int32()), ("value", pa.string()))
        return _lists(found, pa.StructArray.from_arrays(
            [pa.array(column, kind) for column, (_, kind) in zip(columns or (), kinds)] or [pa.array([], kind) for _, kind in kinds],
            names=[name for name, _ in kinds]))

    return F.arrow_udf(walk, f"array<{_NODE}>")(text)


def _lists(found: list[list | None], items: pa.Array) -> pa.Array:
    """The lists of ``found`` as an array over their items, NULL where there is none."""
    ends = list(accumulate((len(one or ()) for one in found), initial=0))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, mask=pa.array([one is None for one in found], pa.bool_()))


def _written(texts: Column, span: Column) -> Column:
    """The text of the tokens of a span, without what stands before its first value."""
    rest = F.slice(texts["whole"], span["first"] + 2, span["last"] - span["first"])
    return F.concat(F.get(texts["value"], span["first"]), F.array_join(rest, ""))


def children(text: Column) -> Column:
    """``struct(key, value)`` of each member or element of a valid JSON container, in order, each value as it is written.

    ``key`` is the name, NULL for elements.  Values may nest as deep as they like.  NULL for a NULL text.
    """
    kind = "array<struct<key: string, first: int, last: int>>"
    tokens = _groups(text, _TOKEN, ("key", 1), ("value", 2))
    start = {"at": F.lit(0), "depth": F.lit(0), "first": F.lit(0), "key": F.lit("")}

    def step(s: Column, t: Column) -> Column:
        ends, opens = _closes(t["value"]), _opens(t["value"])
        begins = ~ends & (s["depth"] == 1)
        depth = s["depth"] + F.when(opens, 1).when(ends, -1).otherwise(0)
        first, key = F.when(begins, s["at"]).otherwise(s["first"]), F.when(begins, t["key"]).otherwise(s["key"])
        whole = (depth == 1) & (begins | ends)
        child = F.struct(F.when(key != "", unquote(key)).alias("key"), first.alias("first"), s["at"].alias("last"))
        lot = F.when(whole, F.concat(s["lot"], F.array(child))).otherwise(s["lot"])
        return F.struct((s["at"] + 1).alias("at"), depth.alias("depth"), first.alias("first"), key.alias("key"), lot.alias("lot"))

    whole = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(2))

    found = _fold(tokens, start, F.array().cast(kind), step, F.flatten)
    return F.when(text.isNotNull(), let(F.struct(whole.alias("whole"), value.alias("value")),
                                        lambda texts: F.transform(found, lambda c: F.struct(
                                            c["key"].alias("key"), _written(texts, c).alias("value")))))


def _members_of(text: str) -> Iterator[tuple[str | None, str | None, str, re.Match]]:
    """``(path, name, value token, token)`` of all members of one text, and tokens of no member, named and placed nowhere."""
    stack: list[str] = []
    for token in _SCAN(text):
        quoted, value = token[1], token[2]
        below, name = stack[-1] if stack else "", None
        if quoted is not None:
            name = _name(quoted)
            below = _joined(below, name)
        yield below, name, value, token
        if value in ("}", "]"):
            stack.pop()
        elif value in ("{", "["):
            stack.append(below)


def _spliced(text: str, flags: list[bool | None], mask: str) -> tuple[str, list[str | None]]:
    """The text with the outermost flagged members masked, and their paths; there is one flag per member."""
    pieces, paths, inside, at, end, flag = [], [], 0, 0, 0, iter(flags)
    for path, _, value, token in _members_of(text):
        hidden = next(flag) if token[1] is not None else False
        step = 1 if value in ("{", "[") else -1 if value in ("}", "]") else 0
        end = token.end()
        if inside:
            inside += step
            at = end
        elif hidden:
            pieces += (text[at:token.start(2)], mask)
            paths.append(path)
            inside, at = step, end
    return "".join((*pieces, text[at:end])), paths


class _Place:
    """A member's path, whether it is hidden, and the members below it that were met, by their key with quotes."""

    __slots__ = ("path", "hidden", "below")

    def __init__(self, path: str, hidden: bool):
        self.path, self.hidden, self.below = path, hidden, {}


class _Masker:
    """Masks texts whose keys need no unquoting, one after the other; each path is judged once."""

    def __init__(self, rule: Callable[[str, str], bool], mask: str):
        self.rule, self.mask, self.root, self.kept = rule, mask, _Place("", False), 0

    def _met(self, parent: _Place, quoted: str) -> _Place:
        name = quoted[1:-1]
        path = _joined(parent.path, name)
        place = parent.below[quoted] = _Place(path, self.rule(path, name))
        self.kept += len(path) + len(quoted)
        return place

    def masked(self, text: str) -> tuple[str, list[str]]:
        """What ``_spliced`` makes of the text."""
        if self.kept > _KEPT_PATHS:
            self.root, self.kept = _Place("", False), 0
        pieces, paths, stack, inside, root = [], [], [], 0, self.root
        for before, quoted, value in _RUNS(text):
            kind = value[0]
            if inside:
                if kind in "{[":
                    inside += len(value)
                elif kind in "}]":
                    inside -= len(value)
                    if inside < 0:
                        # The run closes containers around the hidden one, too.
                        pieces.append(value[inside:])
                        del stack[inside:]
                        inside = 0
                continue
            place = stack[-1] if stack else root
            if quoted:
                place = place.below.get(quoted) or self._met(place, quoted)
                if place.hidden:
                    pieces += (before, self.mask)
                    paths.append(place.path)
                    inside = len(value) if kind in "{[" else 0
                    continue
            pieces += (before, value)
            if kind in "{[":
                stack += [place] * len(value)
            elif kind in "}]":
                del stack[-len(value):]
        return "".join(pieces), paths


def mask_members(text: Column, hidden: Callable[[Column, Column, Column], Column], mask: str,
                 plain: Callable[[str, str], bool] | None = None) -> Column:
    """``struct(raw, paths)``: the text with the values of hidden members replaced by a JSON token, and what was hidden.

    ``hidden(plain path, key, value token)`` decides for each member; one that is inside a hidden one goes with it.  All other
    bytes stay.  A rule that looks at no value may also come as ``plain(path, key)``: it decides in a task, in the same pass, for
    ASCII texts without an escape, where it must say the same.
    """

    def list_members(texts: pa.Array) -> pa.Array:
        found = [None if t is None else [m[:3] for m in _members_of(t) if m[3][1] is not None] for t in texts.to_pylist()]
        columns = list(zip(*(member for one in found if one for member in one))) or [()] * 3
        return _lists(found, pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "name", "value"]))

    def splice(texts: pa.Array, flags: pa.Array) -> pa.Array:
        masker = plain and _Masker(plain, mask)
        made = [None if t is None else masker.masked(t) if f is None else _spliced(t, f, mask)
                for t, f in zip(texts.to_pylist(), flags.to_pylist())]
        paths = [m and m[1] for m in made]
        return pa.StructArray.from_arrays(
            [pa.array([m and m[0] for m in made], pa.string()),
             _lists(paths, pa.array([path for one in paths for path in one or ()], pa.string()))],
            names=["raw", "paths"], mask=pa.array([m is None for m in made], pa.bool_()))

    simple = (F.octet_length(text) == F.length(text)) & ~F.contains(text, F.lit("\\")) if plain else F.lit(False)
    members = F.arrow_udf(list_members, "array<struct<path: string, name: string, value: string>>")(F.when(~simple, text))
    flags = F.transform(members, lambda m: hidden(m["path"], m["name"], m["value"]))
    return F.arrow_udf(splice, "struct<raw: string, paths: array<string>>")(text, flags)


def check(text: Column) -> Column:
    """``struct(valid, fields, depth)`` of a text of any nesting, by the JSON grammar; NULL for a NULL text.

    ``fields`` counts members at every depth, ``depth`` is 1 for a scalar and 1 + the deepest child for a container; both count only
    if the text is valid.  Valid is one JSON value that nests at most ``DEEPEST`` containers.

    Strings are emptied first.  One that is none by the grammar stays and fits into no piece.
    """
    # The stack is a text of the opening brackets: its copies are cheap.
    start = F.struct(F.lit("").alias("open"), F.lit(True).alias("first"), F.lit(True).alias("good"),
                     F.lit(0).alias("fields"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("size"))

    def step(s: Column, t: Column) -> Column:
        level = F.octet_length(s["open"])
        in_object = F.when(level > 0, F.endswith(s["open"], F.lit("{")))
        has_key, has_comma, ends = t["key"] != "", t["comma"] != "", t["ends"] != ""
        closed = F.translate(F.reverse(t["ends"]), "]} \t\n\r", "[{")
        opened = F.translate(F.concat(t["begins"], F.when(t["value"] == "{", "{").otherwise("")), '": \t\n\r', "")
        scalar = (t["value"] != "") & (t["value"] != "{")
        inner = level + F.octet_length(opened) + scalar.cast("int")
        fits_end = F.endswith(s["open"], closed) & ~has_key & ~has_comma
        # A run that begins an object has a key, which needs a value.
        whole = (t["value"] != "") | F.endswith(opened, F.lit("["))
        fits_value = F.when(in_object.isNull(), s["first"] & ~has_key & ~has_comma).otherwise(
            (has_key == in_object) & (has_comma != s["first"])) & whole & (inner <= DEEPEST)
        good = s["good"] & F.when(ends, fits_end).otherwise(fits_value)
        outer = F.substring(s["open"], F.lit(1), level - F.octet_length(closed))
        members = has_key.cast("int") + F.octet_length(t["begins"]) - F.octet_length(F.replace(t["begins"], F.lit(":"), F.lit("")))
        return F.when(~good, s.withField("good", F.lit(False))).otherwise(F.struct(
            F.when(ends, outer).otherwise(F.concat(s["open"], opened)).alias("open"), (~ends & ~scalar).alias("first"), good.alias("good"),
            (s["fields"] + members).alias("fields"),
            F.when(ends, s["depth"]).otherwise(F.greatest(s["depth"], inner)).alias("depth"),
            (s["size"] + F.length(t["whole"])).alias("size")))

    def checked(bare: Column) -> Column:
        pieces = _groups(bare, _EXACT, ("whole", 0), ("comma", 1), ("key", 2), ("ends", 3), ("begins", 4), ("value", 5))
        return F.aggregate(pieces, start, step, lambda s: F.struct(
            (s["good"] & (s["depth"] > 0) & (s["open"] == "") & (s["size"] == F.length(F.rtrim(bare, F.lit(" \t\n\r"))))).alias("valid"),
            s["fields"].alias("fields"), s["depth"].alias("depth")))

    return let(F.regexp_replace(text, _EXACT_STRING, '""'), checked)
