"""Dotted paths such as ``checkpoints[1].name`` and their VARIANT form."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

_PIECE = re.compile(r"\[(?P<index>\d+)\]|(?P<name>[^.\[\]]+)")
_WHOLE = re.compile(r"(?:NAME|INDEX)(?:\.NAME|INDEX|(?<=\])NAME)*(?:(?<=\])\.)?"
                    .replace("NAME", r"[^.\[\]]+").replace("INDEX", r"\[\d+\]"))


def segments(path: str) -> list[str | int]:
    """Names and indexes of a path; ValueError for a malformed one."""
    text = path.strip()
    if not _WHOLE.fullmatch(text):
        raise ValueError(f"invalid path {path!r}")
    found: list[str | int] = []
    for piece in _PIECE.finditer(text):
        if piece["index"] is not None:
            found.append(int(piece["index"]))
        elif piece["name"].strip():
            found.append(piece["name"].strip())
        else:
            raise ValueError(f"invalid path {path!r}: empty segment")
    return found


def variant_path(parts: list[str | int]) -> str:
    """``['a', 0, 'b']`` as ``$['a'][0]['b']``."""
    out = "$"
    for part in parts:
        if isinstance(part, int):
            out += f"[{part}]"
        else:
            quote = '"' if "'" in part else "'"
            out += f"[{quote}{part}{quote}]"
    return out


def extract_path(doc: Column, path: str) -> Column:
    """The node at a path as VARIANT; NULL where it is absent."""
    return F.try_variant_get(doc, variant_path(segments(path)), "variant")


def is_json_string(node: Column) -> Column:
    return F.coalesce(F.schema_of_variant(node) == "STRING", F.lit(False))


def string_at(doc: Column, path: str) -> Column:
    """The text at a plain dotted path of object keys, only if it is a JSON string."""
    node = F.try_variant_get(doc, variant_path(list(path.split("."))), "variant")
    return F.when(is_json_string(node), node.cast("string"))


def plain_text(node: Column) -> Column:
    """A node as a table cell: strings as they are, containers as JSON text, JSON null as NULL."""
    return node.cast("string")


def members(node: Column) -> Column:
    """An object as ``MAP<STRING, VARIANT>``; NULL for anything else."""
    return F.try_variant_get(node, "$", "map<string,variant>")


def elements(node: Column) -> Column:
    """An array as ``ARRAY<VARIANT>``; NULL for anything else."""
    return F.try_variant_get(node, "$", "array<variant>")


def extract_tenant(doc: Column) -> Column:
    """``tenant_id`` if it is a non-empty string, else ``tenant.id``."""
    direct, nested = string_at(doc, "tenant_id"), string_at(doc, "tenant.id")
    return F.coalesce(F.nullif(direct, F.lit("")), F.nullif(nested, F.lit("")))
