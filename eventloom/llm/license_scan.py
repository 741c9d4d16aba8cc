"""Licence scans with DataFrame functions only: a trained paragraph classifier, confirmed by templates.

A paragraph is a line of a text.  Sparse logistic regression over its words and word pairs names a licence family or the
unknown class; its probabilities are calibrated by a temperature.  A family counts only if the paragraph and one of the
family's templates share at least 0.8 of the five-word shingles of the smaller one.

The model is small: it is fitted on the driver from the fixed templates and at most ``SAMPLE_LINES`` lines of the corpus that
stand for the unknown class.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from eventloom.llm.license_templates import OTHERS, TEMPLATES

UNKNOWN = "unknown"
FAMILIES = (*sorted(TEMPLATES), UNKNOWN)
SAMPLE_LINES = 500
SHINGLE = 5
SIMILARITY = 0.8
MIN_PROBABILITY = 0.5
# A paragraph without any of these stems names no licence and is not classified; every template holds one of them.
STEMS = r"(?i)licen[sc]|copyright|permission|redistribut|warrant|public domain"
_NOT_WORD = "[^a-z0-9]+"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(_NOT_WORD, text.lower()) if w]


def features_of(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


def shingles_of(words: list[str]) -> list[str]:
    return sorted({" ".join(words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}) if words else []


@dataclass(frozen=True)
class Model:
    """A weight per feature and family, a bias per family, and the temperature that calibrates the probabilities."""

    weights: dict[str, np.ndarray]
    bias: np.ndarray
    temperature: float

    def probabilities(self, text: str) -> np.ndarray:
        total = self.bias + sum((self.weights[f] for f in sorted(features_of(words_of(text))) if f in self.weights), 0 * self.bias)
        power = np.exp((total - total.max()) / self.temperature)
        return power / power.sum()


def _examples(lines: list[str]) -> list[tuple[list[str], int]]:
    """Templates, whole and in part, alone and among other words; the unknown class from ``lines`` and other sentences."""
    draw = random.Random(7)
    filler = [w for line in lines for w in words_of(line)][:5000] or ["lorem", "ipsum"]
    made = []
    for number, family in enumerate(FAMILIES[:-1]):
        for sentence in TEMPLATES[family]:
            words = words_of(sentence)
            for _ in range(24):
                left, right = (draw.randint(0, max(0, len(words) // 6)) for _ in range(2))
                part = words[left:len(words) - right]
                around = [draw.choice(filler) for _ in range(draw.choice((0, 0, 3, 8)))]
                made.append((part + around if draw.random() < 0.5 else around + part, number))
    unknown = len(FAMILIES) - 1
    made += [(words_of(s), unknown) for s in (*OTHERS, *OTHERS, *lines)]
    return made


def _softmax(logits: np.ndarray) -> np.ndarray:
    power = np.exp(logits - logits.max(axis=1, keepdims=True))
    return power / power.sum(axis=1, keepdims=True)


def train(lines: list[str], steps: int = 400, rate: float = 2.0, ridge: float = 1e-4) -> Model:
    """Multinomial logistic regression by gradient descent; every fifth example is held back for the temperature."""
    examples = _examples(lines)
    vocabulary = sorted({f for family in TEMPLATES.values() for s in family for f in features_of(words_of(s))}
                        | {f for s in OTHERS for f in features_of(words_of(s))})
    column = {f: i for i, f in enumerate(vocabulary)}
    x, y = np.zeros((len(examples), len(vocabulary)), np.float64), np.array([label for _, label in examples])
    for row, (words, _) in enumerate(examples):
        x[row, [column[f] for f in features_of(words) if f in column]] = 1
    held = np.arange(len(y)) % 5 == 0
    weight, bias = np.zeros((len(vocabulary), len(FAMILIES))), np.zeros(len(FAMILIES))
    known, target = x[~held], np.eye(len(FAMILIES))[y[~held]]
    for _ in range(steps):
        gap = (_softmax(known @ weight + bias) - target) / len(known)
        weight -= rate * (known.T @ gap + ridge * weight)
        bias -= rate * gap.sum(axis=0)
    logits = x[held] @ weight + bias
    loss = {t: -np.log(_softmax(logits / t)[np.arange(held.sum()), y[held]] + 1e-12).mean() for t in np.geomspace(0.1, 10, 41)}
    return Model({f: weight[i] for f, i in column.items()}, bias, float(min(loss, key=loss.get)))


def paragraphs(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns``, ``paragraph`` (its number) and ``text`` of every line that holds a stem."""
    lines = docs.where(F.col("text").rlike(STEMS)).select(*columns, F.posexplode(F.split("text", "\n", -1)).alias("paragraph", "text"))
    return lines.where(F.col("text").rlike(STEMS))


def sample_lines(docs: DataFrame, rows: int = SAMPLE_LINES) -> list[str]:
    """At most ``rows`` distinct lines without a stem, those with the smallest hash."""
    lines = docs.select(F.explode(F.split("text", "\n", -1)).alias("line")).where(
        F.length("line").between(20, 2000) & ~F.col("line").rlike(STEMS)).select(F.xxhash64("line").alias("h"), "line")
    # Hashes alone are compared; the chosen ones are ``rows`` at most, so the broadcast is safe.
    chosen = F.broadcast(lines.select("h").distinct().orderBy("h").limit(rows))
    return [r.line for r in lines.join(chosen, "h", "left_semi").groupBy("h").agg(F.min("line").alias("line")).orderBy("h").collect()]


def _hash(text: str) -> int:
    """Spark's ``xxhash64`` of a string."""
    value = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return value - (1 << 64) if value >> 63 else value


def _shingles(words: Column) -> Column:
    last = F.greatest(F.size(words) - SHINGLE, F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, SHINGLE), " "))))


def scan(docs: DataFrame, columns: list[str], model: Model | None = None) -> DataFrame:
    """``columns``, ``paragraph``, ``family``, ``probability``, ``template_share`` and ``confirmed`` of every paragraph with a stem.

    ``family`` is that of the template's family if confirmed, else unknown.  Null and empty texts have no paragraphs; repeated
    rows are scanned each on their own; of families with equal probability the first by name counts.  An empty table
    gives an empty result.  ``columns`` must not be called like a result.
    """
    model = model or train(sample_lines(docs))
    spark = docs.sparkSession
    names = [f"w{i}" for i in range(len(FAMILIES))]
    # The templates bound the vocabulary, so both broadcasts have a fixed size.
    weights = spark.createDataFrame([(_hash(f), *map(float, w)) for f, w in model.weights.items()],
                                    "feature bigint, " + ", ".join(f"{n} double" for n in names))
    templates = spark.createDataFrame([(family, [_hash(s) for s in shingles_of(words_of(t))]) for family, texts in TEMPLATES.items()
                                       for t in texts], "guess string, template array<bigint>")
    found = paragraphs(docs, [F.struct(*columns).alias("_key"), F.monotonically_increasing_id().alias("_row")])
    words = F.filter(F.split(F.lower("text"), _NOT_WORD), lambda w: w != "")
    found = found.select("_key", "_row", "paragraph", words.alias("words"))
    pairs = F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), F.expr("slice(words, 2, size(words))"),
                       lambda a, b: F.concat_ws(" ", a, b))
    features = F.array_distinct(F.transform(F.concat("words", pairs), lambda f: F.xxhash64(f)))
    hits = found.select("*", F.explode(features).alias("feature")).join(F.broadcast(weights), "feature", "left")
    group = ["_row", "paragraph"]
    sums = hits.groupBy(*group).agg(F.first("_key").alias("_key"), F.first("words").alias("words"),
                                    *(F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names))
    logits = [(F.col(n) + float(b)) / model.temperature for n, b in zip(names, model.bias)]
    top = F.greatest(*logits)
    powers = sums.withColumn("powers", F.array(*(F.exp(z - top) for z in logits)))
    total = F.aggregate("powers", F.lit(0.0), lambda a, x: a + x)
    best = F.array_position("powers", F.array_max("powers")).cast("int")
    judged = powers.select("_key", *group, _shingles(F.col("words")).alias("shingles"),
                           F.element_at(F.array(*map(F.lit, FAMILIES)), best).alias("guess"),
                           (F.array_max("powers") / total).alias("probability"))
    share = F.size(F.array_intersect("shingles", "template")) / F.least(F.size("shingles"), F.size("template"))
    confirmed = (F.col("guess") != UNKNOWN) & (F.col("probability") >= MIN_PROBABILITY) & (F.col("template_share") >= SIMILARITY)
    compared = judged.join(F.broadcast(templates), "guess", "left").groupBy(*group).agg(
        F.first("_key").alias("_key"), F.first("guess").alias("guess"), F.first("probability").alias("probability"),
        F.coalesce(F.max(share), F.lit(0.0)).alias("template_share"))
    return compared.select("_key.*", "paragraph", F.when(confirmed, F.col("guess")).otherwise(UNKNOWN).alias("family"),
                           "probability", "template_share", confirmed.alias("confirmed"))
