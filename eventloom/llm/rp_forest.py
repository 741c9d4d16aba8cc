"""Embedding near-dedup by a forest of random-projection trees with spill overlap.

A tree cuts the vectors by random directions at the median; those near a cut go to both sides.  A node whose sampled vectors
lie mostly within the threshold of each other is not cut, as that would lose links.  All vectors of a leaf are compared in
double precision; larger leaves are compared as pairs of blocks, one group a pair.  Equal vectors are one class, so groups of copies cost nothing.  A pair that meets in several
leaves counts in the first, which the leaves of both tell; so leaves emit counts and the edges of a forest, never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventloom.llm.common import cut_lineage
from eventloom.llm.components import connected_components

COSINE = 0.9
TREES = 8
LEAF = 4096  # vectors a leaf should hold
SPILL = 0.05  # share of a node on each side of a cut that goes to both sides
SAMPLE = 32_768  # vectors a node's cuts are fitted on
SUPPORT = 32  # sampled vectors a cut needs
DENSE = 0.5  # share of linked pairs from which a node is not cut
_PROBE = 256  # vectors whose pairs tell that share
MAX_ROUNDS = 5
_BLOCK = 512
_SUBTREE = 1 << 10  # leaves a node may get in a round


def build(sample: np.ndarray, population: int, seed: tuple[int, ...], leaf: int = LEAF, spill: float = SPILL,
          support: int = SUPPORT, cosine: float = COSINE) -> dict:
    """A tree as ``node number -> (low, high)``: both children get what lies between; nodes without an entry are leaves."""
    cuts: dict[int, tuple[float, float]] = {}

    def grow(node: int, rows: np.ndarray) -> None:
        if len(rows) * population <= leaf * max(1, len(sample)) or len(rows) < 2 * support or node >= _SUBTREE // 2:
            return
        probe = sample[rows[::max(1, len(rows) // _PROBE)]]
        if (probe @ probe.T >= cosine).mean() > DENSE:
            return
        places = sample[rows] @ direction(seed, node, sample.shape[1])
        low, high = np.quantile(places, (0.5 - spill, 0.5 + spill))
        if low == places.min() or high == places.max():
            return
        cuts[node] = (float(low), float(high))
        grow(2 * node, rows[places <= high])
        grow(2 * node + 1, rows[places >= low])

    grow(1, np.arange(len(sample)))
    return cuts


def direction(seed: tuple[int, ...], node: int, size: int) -> np.ndarray:
    return np.random.default_rng((*seed, node)).normal(size=size)


def route(vectors: np.ndarray, cuts: dict, seed: tuple[int, ...]) -> list[list[int]]:
    """The leaves of each vector."""
    found: list[list[int]] = [[] for _ in vectors]

    def go(node: int, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node not in cuts:
            for row in rows:
                found[row].append(node)
            return
        low, high = cuts[node]
        places = vectors[rows] @ direction(seed, node, vectors.shape[1])
        go(2 * node, rows[places <= high])
        go(2 * node + 1, rows[places >= low])

    go(1, np.arange(len(vectors)))
    return found


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors, as rows in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def leaf_links(vectors: np.ndarray, sizes: np.ndarray, leaves: list[list[int]], leaf: int, cosine: float = COSINE,
               first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each vector of a leaf: the vectors it links with here for the first time, and the row its group here starts with.

    With ``first``, which tells one of two blocks from the other, only vectors of different blocks link.
    """
    count = len(vectors)
    if count and any(other < leaf for other in set(leaves[0]).intersection(*leaves[1:])):
        return np.zeros(count, np.int64), np.arange(count)
    linked = np.zeros((count, count), bool)
    if first is None:
        for at in range(0, count, _BLOCK):
            linked[at:at + _BLOCK] = vectors[at:at + _BLOCK] @ vectors.T >= cosine
        np.fill_diagonal(linked, False)
    else:
        ones, others = np.flatnonzero(first), np.flatnonzero(~first)
        for at in range(0, len(ones), _BLOCK):
            near = vectors[ones[at:at + _BLOCK]] @ vectors[others].T >= cosine
            linked[np.ix_(ones[at:at + _BLOCK], others)] = near
            linked[np.ix_(others, ones[at:at + _BLOCK])] = near.T
    earlier: dict[int, list[int]] = {}
    for row, own in enumerate(leaves):
        for other in own:
            if other < leaf:
                earlier.setdefault(other, []).append(row)
    for rows in earlier.values():
        if len(rows) > 1:
            linked[np.ix_(rows, rows)] = False
    label = np.arange(count)
    while True:
        least = label.copy()
        for at in range(0, count, _BLOCK):
            part = linked[at:at + _BLOCK]
            least[at:at + _BLOCK] = np.minimum(label[at:at + _BLOCK], np.where(part, label, count).min(axis=1, initial=count))
        if (least == label).all():
            links = [linked[at:at + _BLOCK] @ sizes for at in range(0, count, _BLOCK)]
            return np.concatenate([np.zeros(0, np.int64), *links]), label
        label = least


def _classes(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """``(id, h, size, v)``: one row per distinct vector that can link, with its smallest id."""
    usable = vectors.where(is_usable(column) & F.col(id_column).isNotNull())
    grouped = usable.groupBy(F.col(column).alias("v")).agg(F.min(id_column).alias("id"), F.count("*").alias("size"))
    return grouped.select("id", F.xxhash64("v").alias("h"), "size", "v")


def is_usable(column: str):
    """Not null, not all zero, every component a finite number."""
    value = F.col(column)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(value, lambda x: x != 0), F.lit(False))


_SAMPLED = "leaf bigint, cuts string"


def _split(rows: DataFrame, sizes: DataFrame, leaf: int, sample: int, number: int, support: int,
           cosine: float) -> DataFrame:
    """``rows`` with those of oversized leaves moved to the leaves below.

    Every oversized leaf is fitted on about ``sample`` of its vectors, chosen by hash; its cuts travel as a small text.
    """
    import json

    oversized = sizes.where(F.col("n") > leaf)
    share = F.lit(float(sample)) / F.col("n")
    drawn = rows.join(oversized, "leaf").where(
        F.pmod(F.xxhash64("id", "h", "leaf", F.lit(number)), F.lit(1 << 20)) < share * (1 << 20))

    def fitted(group: pa.Table) -> pa.Table:
        at, population = group.column("leaf")[0].as_py(), group.column("n")[0].as_py()
        cuts = build(matrix(group.column("v")), population, (at, number), leaf, support=support, cosine=cosine)
        return pa.table({"leaf": pa.array([at], pa.int64()), "cuts": [json.dumps(cuts)]})

    trees = drawn.select("leaf", "n", "v").groupBy("leaf").applyInArrow(fitted, _SAMPLED)
    joined = rows.join(trees, "leaf", "left")

    def routed(batches):
        for batch in batches:
            leaves, cuts = batch.column("leaf").to_pylist(), batch.column("cuts").to_pylist()
            take, to = [], []
            by_leaf: dict[int, list[int]] = {}
            for row, (at, text) in enumerate(zip(leaves, cuts)):
                if text is None or text == "{}":
                    take.append(row)
                    to.append(at)
                else:
                    by_leaf.setdefault(at, []).append(row)
            for at, members in by_leaf.items():
                tree = {int(k): tuple(v) for k, v in json.loads(cuts[members[0]]).items()}
                for row, found in zip(members, route(matrix(batch.column("v").take(pa.array(members))), tree, (at, number))):
                    take += [row] * len(found)
                    to += [at * _SUBTREE + node for node in found]
            moved = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64())] + [moved.column(n) for n in ("id", "h", "size", "v")],
                                             names=["leaf", "id", "h", "size", "v"])

    return joined.select("leaf", "id", "h", "size", "v", "cuts").mapInArrow(routed, rows.select("leaf", "id", "h", "size", "v").schema)


def forest(classes: DataFrame, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, support: int = SUPPORT,
           cosine: float = COSINE) -> DataFrame:
    """``(leaf, id, h, size, v)``: every vector in its leaves of every tree.

    All trees start as one leaf each per vector length.  Oversized leaves are split, up to 512 ways a round, until none is left or
    nothing more can be split; rounds grow with the logarithm of the table.  Dense leaves stay as large as they are.
    """
    dealt = classes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    rows = dealt.select((F.col("tree") + F.size("v") * trees).cast("long").alias("leaf"), "id", "h", "size", "v")
    state = None
    for number in range(MAX_ROUNDS):
        sizes = cut_lineage(rows.groupBy("leaf").agg(F.count("*").alias("n")))
        now = sizes.where(F.col("n") > leaf * 1.5).agg(F.count("*"), F.sum(F.xxhash64("leaf", "n").cast("decimal(38,0)"))).first()
        if not now[0] or now == state:
            break
        state = now
        rows = cut_lineage(_split(rows, sizes, leaf, sample, number, support, cosine))
    return rows


def block_pairs(rows: DataFrame, leaf: int) -> DataFrame:
    """``rows`` with ``own``, ``low`` and ``high``: once for each pair of blocks of their leaf that holds their own block.

    Leaves that are not oversized are one block.
    """
    large = rows.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > leaf * 1.5).select(
        "leaf", F.ceil(F.col("n") / leaf).cast("int").alias("blocks"))
    dealt = rows.join(large, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    owned = dealt.withColumn("own", F.pmod(F.xxhash64("id", "h"), F.col("blocks")).cast("int"))
    met = owned.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("blocks", "other")


def link_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", cosine: float = COSINE,
                 **shape: int) -> DataFrame:
    """``id_column``, ``n_links``, ``component_id``, ``kept`` for every row.

    Vectors that are null, zero or hold null or non-finite components, and those with a null id, link with nothing; the
    component of a null id is null and not kept.  Vectors of different lengths never link.  Repeated rows link with each
    other.  An empty table gives an empty result.
    """
    named = vectors.select(F.col(id_column), F.col(column))
    classes = cut_lineage(_classes(named, id_column, column))
    rows = forest(classes, cosine=cosine, **shape)
    signed = rows.groupBy("id", "h").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    kind = named.schema[id_column].dataType.simpleString()
    compared = block_pairs(rows, shape.get("leaf", LEAF)).join(signed, ["id", "h"])

    def linked(group: pa.Table) -> pa.Table:
        sizes = group.column("size").to_numpy()
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        first = None if low == high else group.column("own").to_numpy() == low
        links, label = leaf_links(matrix(group.column("v")), sizes, group.column("leaves").to_pylist(),
                                  group.column("leaf")[0].as_py(), cosine, first)
        some = pa.array(np.flatnonzero(links))
        start = pa.array(label[np.flatnonzero(links)])
        return pa.table({"id": group.column("id").take(some), "h": group.column("h").take(some),
                         "links": pa.array(links[np.flatnonzero(links)], pa.int64()),
                         "id2": group.column("id").take(start), "h2": group.column("h").take(start)})

    found = cut_lineage(compared.groupBy("leaf", "low", "high").applyInArrow(linked, f"id {kind}, h bigint, links bigint, id2 {kind}, h2 bigint"))
    links = found.groupBy("id", "h").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.struct("id", "h").alias("a"), F.struct(
        F.col("id2").alias("id"), F.col("h2").alias("h")).alias("b")), "a", "b")
    groups = groups.select("node.id", "node.h", F.col("component.id").alias("component"))
    of_class = classes.join(links, ["id", "h"], "left").join(groups, ["id", "h"], "left").select(
        F.col("v").alias("_v"), F.col("id").alias("_first"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("_links"),
        F.coalesce("component", "id").alias("_component"))
    able = is_usable(column) & F.col(id_column).isNotNull()
    keyed = named.withColumn("_v", F.when(able, F.col(column)))
    judged = keyed.join(of_class, "_v", "left")
    component = F.coalesce("_component", id_column)
    return judged.select(id_column, F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         F.coalesce(F.col(id_column) == component, F.lit(False)).alias("kept"))
