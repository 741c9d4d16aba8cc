"""The corpus pipeline: classify, drop repeated lines, drop near copies, mask personal data, pack.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and its result is written and read again as
the next one's documents.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventloom.llm import line_dedup, packing, pii, quality_gam, simhash_dedup
from eventloom.llm.common import prepare, table
from eventloom.session import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with ``n_chars`` of the text as it is now."""
    return df.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    prepare(spark)
    found = quality_gam.classify(docs, table(spark, sf_dir, "labels"), list(COLUMNS))
    return found.where(F.col("predicted") == 1).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each line kept once in its first document."""
    prepare(spark)
    return _documents(line_dedup.dedup_lines(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    prepare(spark)
    return simhash_dedup.near_dedup(docs).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    prepare(spark)
    return _documents(pii.mask_pii(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in training sequences."""
    prepare(spark)
    return packing.pack_documents(docs)


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("simhash_dedup", near_copies), ("pii", personal_data),
          ("best_fit_packing", packed)]

# A trained classifier, SimHash and a tokenizer are not to be had in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; in between, Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = os.path.join(shared_folder(spark), f"corpus-{uuid.uuid4().hex}")
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
