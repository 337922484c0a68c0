"""Exact top-k search by inner product with the threshold algorithm.

Vectors are turned into whole numbers and dealt into blocks of bounded size. For
each block the rows are sorted once per dimension. A query reads the list of every
dimension from the end its own component favours, a stretch at a time, scores the rows
it meets, and stops when the k-th score exceeds the threshold, the best score an
unread row can have. Queries are dealt into blocks too; a task handles one block of
either, so memory has a bound and nothing is broadcast. A query's result are the best
rows it found in all blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16_384
BLOCK_QUERIES = 2_048
# Rows read from every list between two looks at the threshold.
STRETCH = 64

FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def whole_numbers(df: DataFrame, scale: int, id_column: str, vector: str) -> DataFrame:
    """vec_id and v, floor(scale * x) of every component; each different row once.

    Rows without an id, and vectors that are null, empty or hold null or non-finite components, are left out.
    """
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & finite
    )
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v")).distinct()


def best_of_each(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores, one per id, ties in order of the ids."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    best = order[np.sort(first)[:k]]
    return ids[best], scores[best]


class SortedLists:
    """A block of vectors with its rows in descending order for every dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.order = np.argsort(-self.vectors, axis=0, kind="stable")

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the query's k best rows.

        Ties go to the smaller id; rows with the query's own id take no part.
        """
        n, dims = self.vectors.shape
        used = np.flatnonzero(query)
        # The end of a list where the products with this query are largest.
        forward = query[used] > 0
        seen = np.zeros(n, bool)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, STRETCH
        while depth < n:
            end = min(n, depth + step)
            top, bottom = self.order[depth:end, used[forward]], self.order[n - end : n - depth, used[~forward]]
            fresh = np.zeros(n, bool)
            fresh[top.ravel()] = True
            fresh[bottom.ravel()] = True
            if not len(used):
                fresh[depth:end] = True
            rows = np.flatnonzero(fresh & ~seen)
            seen[rows] = True
            rows = rows[self.ids[rows] != query_id]
            ids = np.concatenate([ids, self.ids[rows]])
            scores = np.concatenate([scores, self.vectors[rows] @ query])
            ids, scores = best_of_each(ids, scores, k)
            depth, step = end, 2 * step
            if seen.all():
                break
            if depth < n and len(scores) == k:
                at = np.where(forward, self.order[end - 1, used], self.order[n - end, used])
                threshold = int(self.vectors[at, used] @ query[used])
                if scores[-1] > threshold:
                    break
        return ids, scores


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int, scale: int = 256, id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id and score of the k highest inner products of every query.

    `queries` has the columns of `vectors`. Components become floor(scale * x). A candidate is any row with
    an id other than the query's; ties go to the smaller id. Repeated rows count once; rows of one id
    with different vectors count with the best score. A query with fewer candidates gets all
    of them; empty tables give an empty result. Vectors of another length than the query's are no candidates.
    Inner products must fit into 64 bits.
    """
    rows = whole_numbers(vectors, scale, id_column, vector)
    wanted = whole_numbers(queries, scale, id_column, vector)
    row_blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    query_blocks = max(1, -(-wanted.count() // BLOCK_QUERIES))
    spread = F.xxhash64("vec_id", "v")

    def each(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = rows.select(
        "vec_id", "v", F.size("v").alias("dims"), F.pmod(spread, row_blocks).cast("int").alias("i"), each(query_blocks).alias("j")
    )
    right = wanted.select(
        "vec_id", "v", F.size("v").alias("dims"), each(row_blocks).alias("i"), F.pmod(spread, query_blocks).cast("int").alias("j")
    )

    def matrix(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        flat = block.column("v").combine_chunks()
        values = flat.flatten().to_numpy()
        return block.column("vec_id").to_numpy(), values.reshape(block.num_rows, -1)

    def search(block: pa.Table, asked: pa.Table) -> pa.Table:
        if not block.num_rows or not asked.num_rows:
            return FOUND.empty_table()
        lists = SortedLists(*matrix(block))
        found = []
        for query_id, query in zip(*matrix(asked), strict=True):
            ids, scores = lists.search(query_id, query, k)
            found.append((np.full(len(ids), query_id), ids, scores))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=FOUND)

    place = ["dims", "i", "j"]
    found = left.groupBy(place).cogroup(right.groupBy(place)).applyInArrow(
        search, "query_id long, vec_id long, score long"
    )
    # One query id may stand for several vectors; each pair of ids then counts with its best score.
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
