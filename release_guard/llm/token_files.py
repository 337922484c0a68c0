"""Token ids in directly addressable codes: files that give any token without decoding a block.

An id is cut into 8-bit chunks, lowest first. Level k holds chunk k of those ids
that have one; a bitmap beside it tells which of them go on, and a rank
directory holds the number of set bits before every 512 bits. Token i is read by
following one position per level: the next position is the rank of this one.

A file set is a folder of Parquet rows, one per segment, in ascending order of
documents: `part` and `seq` order the segments, `doc_ids` and `lengths` list the
documents, `levels`, `bitmaps` and `ranks` hold the codes. Spark writes and reads it,
so it may lie in any store, and a lost task is simply run again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_groups, text_or_empty
from .tokens import text_ids

# Ids after which a segment is closed.
SEGMENT_IDS = 1 << 20
# Pieces and parts of pieces the encoder remembers here, where a task holds little else.
REMEMBERED = 1_000_000, 400_000
RANK_BITS = 512

SEGMENT = pa.schema(
    [
        ("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
        ("levels", pa.list_(pa.binary())), ("bitmaps", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())),
    ]
)
SEGMENT_DDL = (
    "part int, seq int, n_ids long, doc_ids array<long>, lengths array<long>, "
    "levels array<binary>, bitmaps array<binary>, ranks array<binary>"
)


def encode_codes(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, bitmaps and rank directories of unsigned 32-bit ids."""
    levels, bitmaps, ranks = [], [], []
    rest = ids.astype("<u4")
    while True:
        levels.append((rest & 255).astype(np.uint8).tobytes())
        rest = rest >> 8
        more = rest > 0
        bitmaps.append(np.packbits(more, bitorder="little").tobytes())
        sums = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS)) if len(more) else np.zeros(0)
        ranks.append(np.concatenate([[0], np.cumsum(sums)]).astype("<u4").tobytes())
        if not more.any():
            return levels, bitmaps, ranks
        rest = rest[more]


def decode_codes(levels: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids of a segment."""
    ids = np.frombuffer(levels[0], np.uint8).astype("<u4")
    at = np.arange(len(ids))
    for k in range(1, len(levels)):
        more = np.unpackbits(np.frombuffer(bitmaps[k - 1], np.uint8), bitorder="little", count=len(at))
        at = at[more.astype(bool)]
        ids[at] |= np.frombuffer(levels[k], np.uint8).astype("<u4") << np.uint32(8 * k)
    return ids


def token_at(levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes], i: int) -> int:
    """Token i of a segment: one byte per level, found by rank."""
    token = 0
    for k, (level, bitmap, rank) in enumerate(zip(levels, bitmaps, ranks, strict=True)):
        token |= level[i] << (8 * k)
        if not bitmap[i >> 3] >> (i & 7) & 1:
            break
        block = i // RANK_BITS
        before = int.from_bytes(bitmap[block * RANK_BITS // 8 : (i >> 3) + 1], "little")
        before &= (1 << (i - block * RANK_BITS)) - 1
        i = int.from_bytes(rank[4 * block : 4 * block + 4], "little") + before.bit_count()
    return token


def write_token_files(
    df: DataFrame, path: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text: str = "text"
) -> None:
    """Encode every whole text, append `end_id`, and write the ids in ascending order of the id column.

    Rows without an id come first. Rows of a repeated id keep the order of the input,
    each as a document of its own. Null texts hold the end id alone. An empty table gives an empty file set.
    """
    spark = df.sparkSession
    end = np.asarray([end_id], "<u4").tobytes()
    # The row number splits an id that holds very many rows over several ranges.
    ordered = (
        df.select(
            F.col(id_column).cast("long").alias("doc_id"),
            F.monotonically_increasing_id().alias("place"),
            text_or_empty(text).alias("text"),
        )
        .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "place")
        .sortWithinPartitions("doc_id", "place")
        .select(F.spark_partition_id().alias("part"), "doc_id", "text")
    )

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list = []
        held: list[bytes] = []
        size, seq, part = 0, 0, 0

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            levels, bitmaps, ranks = encode_codes(ids)
            row = {
                "part": part, "seq": seq, "n_ids": len(ids), "doc_ids": docs,
                "lengths": [len(x) // 4 for x in held], "levels": levels, "bitmaps": bitmaps, "ranks": ranks,
            }
            return pa.RecordBatch.from_pylist([row], schema=SEGMENT)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            ids = text_ids(tokenizer, batch.column(2).to_pylist(), *REMEMBERED)
            for doc, tokens in zip(batch.column(1).to_pylist(), ids, strict=True):
                docs.append(doc)
                held.append(tokens + end)
                size += len(held[-1]) // 4
                if size >= SEGMENT_IDS:
                    yield closed()
                    docs, held, size, seq = [], [], 0, seq + 1
        if docs:
            yield closed()

    ordered.mapInArrow(segments, SEGMENT_DDL).write.parquet(path)


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, seq and the number of ids before each segment, from the two small columns alone."""
    sizes = spark.read.parquet(path).select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row per partition of the writing job, whatever the size of the input.
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return (
        sizes.select("part", "seq", F.coalesce(inside, F.lit(0)).alias("inside"))
        .join(parts, "part")
        .select("part", "seq", (F.col("part_start") + F.col("inside")).alias("segment_start"))
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a file set: doc_id, part, seq, ids before it in its segment, ids, crc32 of its ids."""
    schema = pa.schema(
        [
            ("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()),
            ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()),
        ]
    )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = decode_codes(row["levels"], row["bitmaps"]).tobytes()
                lengths = np.asarray(row["lengths"], np.int64)
                starts = np.cumsum(lengths) - lengths
                crc = [zlib.crc32(data[4 * s : 4 * (s + n)]) for s, n in zip(starts, lengths, strict=True)]
                n = len(lengths)
                columns = [[row["part"]] * n, [row["seq"]] * n, row["doc_ids"], starts, lengths, crc]
                whole = pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema
                )
                for start, end in row_groups([1] * n, 10_000):
                    yield whole.slice(start, end - start)

    stored = spark.read.parquet(path).select("part", "seq", "doc_ids", "lengths", "levels", "bitmaps")
    return stored.mapInArrow(documents, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read back from the files."""
    return (
        read_documents(spark, path)
        .join(segment_starts(spark, path), ["part", "seq"])
        .select("doc_id", (F.col("segment_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )


def tokens_at(spark: SparkSession, path: str, places: DataFrame, place: str = "place") -> DataFrame:
    """place and token_id for places counted over the whole file set, by rank and without decoding segments.

    Null places and places outside the file set give no row; a repeated place gives one row.
    """
    starts = segment_starts(spark, path)
    sizes = spark.read.parquet(path).select("part", "seq", "n_ids")
    # A place falls into one bucket of SEGMENT_IDS places; a segment lies over a few of them.
    last = F.col("segment_start") + F.col("n_ids") - 1
    spans = (
        starts.join(sizes, ["part", "seq"])
        .where("n_ids > 0")
        .withColumn("bucket", F.explode(F.sequence(F.floor(F.col("segment_start") / SEGMENT_IDS), F.floor(last / SEGMENT_IDS))))
    )
    wanted = places.select(F.col(place).cast("long").alias("place")).where("place >= 0").distinct()
    wanted = wanted.withColumn("bucket", F.floor(F.col("place") / SEGMENT_IDS))
    found = wanted.join(spans, "bucket").where(
        (F.col("place") >= F.col("segment_start")) & (F.col("place") < F.col("segment_start") + F.col("n_ids"))
    )
    found = found.select("part", "seq", "place", (F.col("place") - F.col("segment_start")).alias("i"))
    codes = spark.read.parquet(path).select("part", "seq", "levels", "bitmaps", "ranks")
    # Places of a segment in pages, so that each page meets the codes of the segment once.
    pages = found.groupBy("part", "seq", F.floor(F.col("i") / 65536).alias("page")).agg(
        F.collect_list(F.struct("place", "i")).alias("wanted")
    )

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes = row["levels"], row["bitmaps"], row["ranks"]
                yield pa.RecordBatch.from_pydict(
                    {
                        "place": pa.array([w["place"] for w in row["wanted"]], pa.int64()),
                        "token_id": pa.array([token_at(*codes, w["i"]) for w in row["wanted"]], pa.int64()),
                    }
                )

    return (
        pages.join(codes, ["part", "seq"])
        .select("levels", "bitmaps", "ranks", "wanted")
        .mapInArrow(tokens, "place long, token_id long")
    )
