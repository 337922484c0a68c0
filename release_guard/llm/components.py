"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _smallest(edges: DataFrame) -> DataFrame:
    """Per node u its smallest neighbour or itself; combined before the shuffle."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of the edges a - b.

    Large-star and small-star steps in turn: every node hands its larger, then its smaller
    neighbours to the smallest one, until each node hangs on the smallest node of its
    component. The number of rounds grows with the logarithm of the diameter; edges that
    hang on smallest nodes already, as an earlier result does, add none.
    Each round is written to the shared folder. Loops and repeated edges are
    ignored; an empty table gives an empty one.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = stored(edges, "edges")
    state = _state(edges)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = (
            both.join(_smallest(both), "u")
            .where("v > u and v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            # Dealt out by node once, for the repeats, the smallest neighbours and the join.
            .repartition("u")
            .distinct()
        )
        small = large.join(_smallest(large), "u")
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            small.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
        edges = stored(small.where("a <> b").distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    # Nothing changes any more only if every edge leads from a node to its smallest one.
    roots = edges.select("b").distinct()
    return edges.toDF("node", "component").unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("component")))
