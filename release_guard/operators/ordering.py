"""Sorts, top-k and ordered lists that stay bounded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.versions import version_part


def last_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows in arrival order, returned oldest first."""
    return df.orderBy(F.desc(order)).limit(n).orderBy(F.asc(order))


def newest_first(df: DataFrame, n: int | None, arrival: str = "seq", created: str = "created_at") -> DataFrame:
    """The last n rows by arrival, newest creation time first."""
    chosen = df if n is None else df.orderBy(F.desc(arrival)).limit(n)
    return chosen.orderBy(F.desc(created), F.desc(arrival))


def sort_versions(df: DataFrame, version: str = "version", *ties: str) -> DataFrame:
    """Numeric major, minor, patch order.

    The tie columns let range partitioning split a version that many rows share.
    """
    parts = [version_part(F.col(version), i) for i in range(3)]
    return df.orderBy(*parts, version, *ties)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of every group, numbered in ``rn``.

    Spark keeps only n rows per group in each task before the shuffle, so one
    large group does not end up whole in one task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= n)


def ordered_pages(
    df: DataFrame, keys: Sequence[str], seq: str, item: Column, width: int = 1000
) -> DataFrame:
    """Ordered lists per key, cut into pages by ranges of ``seq``.

    A page holds the items whose ``seq`` falls in one range of ``width``
    numbers. Where ``seq`` counts up within a key, no list is longer than
    ``width`` however many rows the key has, and the pages of a key put behind
    each other are the whole list. Nothing is dropped.
    """
    entry = F.struct(F.col(seq).alias("seq"), item.alias("item"))
    return (
        df.withColumn("page", F.floor(F.col(seq) / width).cast("bigint"))
        .groupBy(*keys, "page")
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        .select(
            *keys,
            "page",
            F.size("entries").cast("bigint").alias("n"),
            F.transform("entries", lambda e: e["item"]).alias("items"),
        )
    )
