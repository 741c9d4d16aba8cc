"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting cycles through the features; each step fits a shallow tree to one feature's bins and adds it to that feature's
lookup table, so that the order of features matters little.  The pairs with most signal left get tables over two features in
the same way.  A document's score is the sum of one entry per table, looked up for whole batches at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from eventloom.llm.common import SPACES, map_batches, texts_of
from eventloom.llm.quality_rules import measure

# Labelled rows the fit may use; the model is fitted on the driver from this many rows of numbers.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
FEATURES = ("log_words", "word_length", "symbols", "capitals", "digits", "marks", "stops", "dup_lines", "repeats", "adjacent",
            "distinct", "line_words", "spaces", "wide")
_RARE = 1e-9


def features(text: bytes) -> list[float]:
    """Numbers that describe a text; all are shares or logarithms, so that long texts are no outliers."""
    n_words, word_chars, n_symbols, n_dup, n_repeat, n_lines, _ = measure(text)
    words, packed = text.lower().split(), text.translate(None, SPACES)
    size, count = len(packed) + _RARE, n_words + _RARE

    def share(which: bytes) -> float:
        return (len(packed) - len(packed.translate(None, which))) / size

    return [
        float(np.log1p(n_words)), word_chars / count, n_symbols / size, share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"0123456789"),
        share(b"!?;:()[]{}\"'"), share(b".,"), n_dup / (n_lines + _RARE), n_repeat / count,
        sum(a == b for a, b in zip(words, words[1:])) / count, len(set(words)) / (n_words + _RARE) ** 0.75 if n_words else 0.0,
        float(np.log1p(n_words / (n_lines + _RARE))), (len(text) - len(packed)) / (len(text) + _RARE),
        (len(packed) - word_chars) / size,
    ]


def feature_matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Model:
    """``cuts`` of each feature, a table per feature, and tables of pairs over coarser cuts."""

    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    bias: float = 0.0
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, values: np.ndarray) -> np.ndarray:
        """Probability of the good label for each row."""
        total = np.full(len(values), self.bias)
        for j, (cuts, lookup) in enumerate(zip(self.cuts, self.tables)):
            total += lookup[np.searchsorted(cuts, values[:, j], side="right")]
        for a, b, lookup in self.pairs:
            total += lookup[np.searchsorted(self.pair_cuts[a], values[:, a], side="right"),
                            np.searchsorted(self.pair_cuts[b], values[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _quantile_cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_cut(gradient: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best split of an ordered histogram."""
    if len(gradient) < 2:
        return 0.0, 0
    left_g, left_w = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1]
    g, w = gradient.sum(), weight.sum()
    gain = left_g ** 2 / (left_w + ridge) + (g - left_g) ** 2 / (w - left_w + ridge) - g ** 2 / (w + ridge)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(gradient: np.ndarray, weight: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """A shallow tree over an ordered histogram, as its value in each bin."""
    gain, at = _best_cut(gradient, weight, ridge) if depth else (0.0, 0)
    if gain <= 0:
        return np.full(len(gradient), gradient.sum() / (weight.sum() + ridge))
    return np.concatenate([_tree(gradient[:at], weight[:at], depth - 1, ridge), _tree(gradient[at:], weight[at:], depth - 1, ridge)])


def _square_tree(gradient: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts one axis of a grid, then the other on both sides."""
    best, value = 0.0, np.zeros_like(gradient)
    for axis in (0, 1):
        g, w = (gradient, weight) if axis == 0 else (gradient.T, weight.T)
        for at in range(1, len(g)):
            made, gain = np.empty_like(g), -g.sum() ** 2 / (w.sum() + ridge)
            for part in (slice(0, at), slice(at, None)):
                side_g, side_w = g[part].sum(axis=0), w[part].sum(axis=0)
                leaf = _tree(side_g, side_w, 1, ridge)
                gain += float((2 * leaf * side_g - leaf ** 2 * (side_w + ridge / len(side_g))).sum())
                made[part] = leaf
            if gain > best:
                best, value = gain, made if axis == 0 else made.T
    return best, value


def fit(values: np.ndarray, labels: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = 32, pair_bins: int = 6,
        n_pairs: int = 6, pair_rounds: int = 20, ridge: float = 2.0) -> Model:
    """Boosts feature by feature, then pair by pair.  Without two classes the model is the constant rate of good labels."""
    cuts = [_quantile_cuts(values[:, j], bins) if len(values) else np.empty(0) for j in range(len(FEATURES))]
    model = Model(cuts, [np.zeros(len(c) + 1) for c in cuts])
    mean = (labels.sum() + 1) / (len(labels) + 2)
    model.bias = float(np.log(mean / (1 - mean)))
    if len(np.unique(labels)) < 2:
        return model
    placed = [np.searchsorted(c, values[:, j], side="right") for j, c in enumerate(cuts)]
    total = np.full(len(labels), model.bias)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for at, lookup in zip(placed, model.tables):
            gradient, weight = residuals()
            added = rate * _tree(np.bincount(at, gradient, len(lookup)), np.bincount(at, weight, len(lookup)), 2, ridge)
            lookup += added
            total += added[at]
    model.pair_cuts = [_quantile_cuts(values[:, j], pair_bins) for j in range(len(FEATURES))]
    coarse = [np.searchsorted(c, values[:, j], side="right") for j, c in enumerate(model.pair_cuts)]
    sizes = [len(c) + 1 for c in model.pair_cuts]

    def grid(a: int, b: int) -> tuple[np.ndarray, tuple[float, np.ndarray]]:
        gradient, weight = residuals()
        cell = coarse[a] * sizes[b] + coarse[b]
        g, w = (np.bincount(cell, x, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b]) for x in (gradient, weight))
        return cell, _square_tree(g, w, ridge)

    ranked = sorted(combinations(range(len(FEATURES)), 2), key=lambda p: (-grid(*p)[1][0], p))
    model.pairs = [(a, b, np.zeros((sizes[a], sizes[b]))) for a, b in ranked[:n_pairs]]
    for _ in range(pair_rounds):
        for a, b, lookup in model.pairs:
            cell, (_, value) = grid(a, b)
            lookup += rate * value
            total += rate * value.ravel()[cell]
    return model


def held_out(id_column: Column) -> Column:
    """Rows whose labels are never learnt from; a null id is none of them."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits a model on at most ``sample_rows`` labelled documents, those with the smallest hash of the id.

    Null labels are left out; where labels of an id differ, or an id has several texts, the smallest counts.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col(id_column).isNotNull() & ~held_out(F.col(id_column)))
    named = usable.groupBy(F.col(id_column).alias("_id")).agg(F.min("quality").cast("int").alias("_label"))
    # Bounded by sample_rows, so the broadcast is safe whatever the size of the tables.
    chosen = F.broadcast(named.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows))
    texts = docs.select(F.col(id_column).alias("_id"), "text").join(chosen, "_id")

    def described(batch: pa.RecordBatch) -> dict:
        return {"_id": batch.column("_id"), "_label": batch.column("_label"),
                "x": pa.array(list(feature_matrix(texts_of(batch.column("text")))), pa.list_(pa.float64()))}

    kind = texts.schema["_id"].dataType.simpleString()
    made = map_batches(texts, described, f"_id {kind}, _label int, x array<double>")
    rows = made.groupBy("_id").agg(F.min(F.struct("_label", "x")).alias("row")).orderBy("_id").toArrow()
    found = rows.column("row").to_pylist()
    values = np.array([r["x"] for r in found], np.float64).reshape(len(found), len(FEATURES))
    return fit(values, np.array([r["_label"] for r in found], np.float64))


def score_documents(docs: DataFrame, columns: list[str], model: Model) -> DataFrame:
    """``columns`` and ``score`` of every whole text.

    Null and empty texts are scored like a text of no words.  Repeated rows get equal scores; an empty table gives an empty
    result.  ``columns`` must not be called ``score``.
    """

    def scored(batch: pa.RecordBatch) -> dict:
        return {c: batch.column(c) for c in columns} | {"score": model.score(feature_matrix(texts_of(batch.column("text"))))}

    chosen = docs.select(*columns) if "text" in columns else docs.select(*columns, "text")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.select(*columns).schema) + ", score double"
    return map_batches(chosen, scored, shape)


def classify(docs: DataFrame, labels: DataFrame, columns: list[str], id_column: str = "doc_id") -> DataFrame:
    """``columns``, ``score`` and ``predicted``: 1 from a score of 0.7 on."""
    scored = score_documents(docs, columns, train(docs, labels, id_column))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
