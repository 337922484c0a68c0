"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir, ship_package


# Bytes of an Arrow batch: texts are long, and every task holds several batches at once.
ARROW_BYTES = 4 << 20
# Bytes of a Parquet row group: a task that writes holds one in memory.
ROW_GROUP_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """What the jobs of this subpackage need of a session: the package on the workers, small Arrow batches and row groups."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("parquet.block.size", str(ROW_GROUP_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(text: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def text_key(text: str = "text") -> Column:
    """A fingerprint of the text, which tells rows of a repeated id apart."""
    return F.xxhash64(text_or_empty(text))


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_groups(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes add up to about `most`."""
    start = total = rows = 0
    for i, size in enumerate(sizes):
        rows = i + 1
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if rows > start:
        yield start, rows


def small_side(df: DataFrame, most: int = 500_000) -> DataFrame:
    """Mark a written table for broadcast if it has few rows; a larger one is joined by shuffle.

    For tables of two or three numbers a row, so that the bound is one of some ten MB.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


@contextmanager
def stored_for_now(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """A written table for the jobs inside the block, which write their results; it is emptied after them."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    yield spark.read.parquet(path)
    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)
