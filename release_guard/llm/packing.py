"""Best-two-fit packing of token pieces into sequences of a fixed capacity.

The driver sees only how many pieces there are of each length, at most
`capacity` numbers. On them it fills one bin after the other greedily, the largest
length that fits first, and then replaces the bin's smallest piece by the two
unpacked ones that fit its expanded gap more tightly. A bin is repeated while its
lengths last, so the plan has a few steps per length, whatever the number of pieces. Then
every piece finds its place from its rank among the pieces of its length; ranks
are counted in blocks of rows, so that a length most rows share is split.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import text_or_empty
from .tokens import REMEMBERED, text_ids

BLOCK_ROWS = 1 << 16


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n ids: whole ones, the rest in front."""
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def encode_pieces(
    df: DataFrame, tokenizer: str, end_id: int, capacity: int, id_column: str = "doc_id", text: str = "text",
    keep_ids: bool = False, remembered: tuple[int, int] = (REMEMBERED, REMEMBERED // 5),
) -> DataFrame:
    """Every whole text as ids with `end_id` behind, cut into pieces of at most `capacity` ids.

    Returns doc_id, piece (from 0), start (ids of the document before it), length, ids_crc32 and
    block, which bounds the rows that are ranked together; `keep_ids` adds the ids
    as little-endian unsigned 32-bit numbers. A null text is empty and gives one piece with the end id
    alone; rows of a repeated id are documents of their own. `remembered` tells how many pieces and parts
    of pieces a worker keeps, see PieceEncoder.
    """
    end = np.asarray([end_id], "<u4").tobytes()
    fields = [
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("block", pa.int64()),
    ]
    schema = pa.schema(fields + [("ids", pa.binary())] * keep_ids)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, blocks, texts = (column.to_pylist() for column in batch.columns)
            rows: list[tuple] = []
            for doc, block, ids in zip(docs, blocks, text_ids(tokenizer, texts, *remembered), strict=True):
                data = ids + end
                cuts = np.cumsum([0, *piece_lengths(len(data) // 4, capacity)]).tolist()
                for i, (a, b) in enumerate(pairwise(cuts)):
                    own = data[4 * a : 4 * b]
                    rows.append((doc, i, a, b - a, zlib.crc32(own), block) + (own,) * keep_ids)
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, block long"
    return df.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.floor(F.monotonically_increasing_id() / BLOCK_ROWS).alias("block"),
        text_or_empty(text).alias("text"),
    ).mapInArrow(pieces, ddl + ", ids binary" * keep_ids)


def tightest_pair(lengths: list[int], left: Counter, least: int, most: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum over `least` and up to `most`."""
    best, found = least, None
    low, high = 0, bisect_right(lengths, most) - 1
    while low <= high and best < most:
        a, b = lengths[low], lengths[high]
        if a + b > most:
            high -= 1
        else:
            if a + b > best and (low < high or left[a] > 1):
                best, found = a + b, (a, b)
            low += 1
    return found


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths in descending order, how often), for so many pieces of each length."""
    left = Counter({length: n for length, n in counts.items() if n > 0})
    lengths = sorted(left)
    bins = []
    while lengths:
        used: Counter = Counter()
        own: list[int] = []
        gap = capacity
        at = len(lengths) - 1
        while at >= 0:
            at = min(at, bisect_right(lengths, gap) - 1)
            if at < 0:
                break
            fits = min(left[lengths[at]], gap // lengths[at])
            used[lengths[at]] += fits
            own += [lengths[at]] * fits
            gap -= fits * lengths[at]
            at -= 1
        if gap and len(own) > 1:
            small = own[-1]
            unpacked = left - used
            pair = tightest_pair(sorted(unpacked), unpacked, small, gap + small)
            if pair:
                own = sorted([*own[:-1], *pair], reverse=True)
        times = min(left[length] // n for length, n in Counter(own).items())
        bins.append((own, times))
        for length, n in Counter(own).items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
                lengths.remove(length)
    return bins


def places(bins: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces of it per bin, first sequence, offset), by length and rank."""
    rows, taken, sequence = [], Counter(), 0
    for own, times in bins:
        offset = 0
        for length, n in sorted(Counter(own).items(), reverse=True):
            rows.append((length, taken[length], n, sequence, offset))
            taken[length] += n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to pieces as `encode_pieces` returns them.

    Every piece lies in one sequence, sequences hold at most `capacity` ids, and
    offsets have no gap. Pieces longer than the capacity are an error. An
    empty table stays empty. The pieces are written to the shared folder once, so that
    counting and placing see the same rows whichever executors are lost.
    """
    pieces = stored(pieces, "pieces")
    columns = pieces.columns
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if counts and max(counts) > capacity:
        raise ValueError(f"a piece has {max(counts)} ids, the capacity is {capacity}")
    plan = places(best_two_fit(counts, capacity))

    block = Window.partitionBy("length", "block")
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = pieces.groupBy("length", "block").agg(F.count("*").alias("n"))
    firsts = firsts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = (
        pieces.withColumn("rank", F.row_number().over(block.orderBy("doc_id", "piece", "ids_crc32")) - 1)
        .join(firsts, ["length", "block"])
        .select(*columns, (F.col("rank") + F.col("first")).alias("rank"))
    )

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (plan[:, 0] << 44) + plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(name).to_numpy() for name in ("length", "rank"))
            row = plan[np.searchsorted(key, (length << 44) + rank, side="right") - 1]
            copy, slot = np.divmod(rank - row[:, 1], row[:, 2])
            kept = batch.select(columns)
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(row[:, 3] + copy), pa.array(row[:, 4] + slot * length)],
                names=[*columns, "sequence_id", "offset"],
            )

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(placed, f"{ddl}, sequence_id long, offset long").drop("block")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids in order, from packed pieces that kept their ids.

    A sequence is bounded by the capacity, so are the pieces collected for it.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda whole, part: F.concat(whole, part["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
