"""What the corpus operators share: session settings, table access, row ids, lineage cuts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from eventloom.session import configure, cut_lineage

# ASCII white space, [\x20\x09-\x0D]: what ``bytes.split()`` splits at.
SPACES = b" \t\n\x0b\x0c\r"

__all__ = ["SPACES", "cut_lineage", "map_batches", "prepare", "table", "texts_of", "with_row"]


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    # Rows of text are large: small batches bound what a Python worker holds.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def with_row(df: DataFrame, *columns: str) -> DataFrame:
    """The columns and ``_row``, a number for each row that tells repeated rows apart.

    It is the same on every read as long as ``df`` reads a stored table: recomputed tasks number alike.
    """
    return df.select(F.monotonically_increasing_id().alias("_row"), *columns)


def map_batches(df: DataFrame, columns: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``mapInArrow`` with a function from one batch to the columns of the result."""
    names = [field.name for field in df.sparkSession.createDataFrame([], schema).schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = columns(batch)
            yield pa.RecordBatch.from_arrays([made[n] if isinstance(made[n], pa.Array) else pa.array(made[n])
                                              for n in names], names=names)

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]
