"""Every node of a JSON document as a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from eventloom.functions import tokens
from eventloom.operators.settle import settle


def json_nodes(df: DataFrame, text: str = "raw", keep: tuple[str, ...] = (), containers: bool = False) -> DataFrame:
    """Rows ``(keep..., path, key, depth, value)``, one per node, the root included; containers follow their children.

    ``text`` holds valid JSON or NULL.  ``path`` carries array indexes (``a.b[0]``); ``key`` is NULL for the root and for array
    elements; ``value`` is the text of a scalar as written, that of a container only where ``containers`` asks for it, else NULL.
    Where an object repeats a key, its last value counts.

    One pass over the tokens of a text and one ``inline``: narrow, the input is read once, and no depth is too great.
    """
    chosen = df.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("_text"))
    walked = settle(chosen.withColumn("_nodes", tokens.nodes(F.col("_text"), containers)), "_nodes")
    # Nodes of a repeated key share a path; only such texts are parsed, which leaves one of them, and walked again.
    paths = F.col("_nodes.path")
    single = F.when(F.size(F.array_distinct(paths)) < F.size(paths), F.to_json(F.try_parse_json("_text")))
    again = F.coalesce(tokens.nodes(single, containers), F.col("_nodes"))
    return walked.select(*keep, F.inline(again))


def is_text(value: Column) -> Column:
    """Whether a node is a JSON string."""
    return F.startswith(value, F.lit('"'))
