"""Text files as rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.matching import Matcher
from ..functions.text import matches_any_glob
from ..operators.secrets import scanned_files
from ..session import ship_package, stored


def read_files(
    spark: SparkSession,
    source: str | DataFrame,
    include: Sequence[str] = tuple(rules.DEFAULT_INCLUDE),
    exclude: Sequence[str] = tuple(rules.DEFAULT_EXCLUDE),
    max_size: int | None = None,
) -> DataFrame:
    """One row per file: ``file, content, size``; for files of up to 2 GB, ``read_lines`` has no such limit.

    ``source`` is a folder, or a table that already has ``file`` and
    ``content``. For a folder, names and sizes are tested on the file listing,
    so files that are left out are not read.
    """
    if isinstance(source, DataFrame):
        files = source
        if "size" not in files.columns:
            files = files.withColumn("size", F.octet_length("content").cast("bigint"))
        return scanned_files(files, include, exclude, max_size)
    root = source.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    listed = _chosen(raw, root, include, exclude, max_size)
    return listed.select(
        _name(root).alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.col("length").alias("size")
    )


def _name(root: str) -> Column:
    """The path of a row's file below the folder."""
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, f"^.*?{_quoted(root)}/", "")


def _chosen(
    raw: DataFrame, root: str, include: Sequence[str], exclude: Sequence[str], max_size: int | None
) -> DataFrame:
    name = _name(root)
    listed = raw.filter(matches_any_glob(name, list(include)) & ~matches_any_glob(name, list(exclude)))
    return listed if max_size is None else listed.filter(F.col("_metadata.file_size") <= max_size)


def read_lines(
    spark: SparkSession,
    root: str,
    include: Sequence[str] = tuple(rules.DEFAULT_INCLUDE),
    exclude: Sequence[str] = tuple(rules.DEFAULT_EXCLUDE),
    max_size: int | None = None,
    stream: bool = False,
) -> DataFrame:
    """The lines of all files below a folder as ``file, size, block, text, octets``, batch or stream.

    Spark cuts files into byte ranges (``spark.sql.files.maxPartitionBytes``) and reads each in a task of its own; a line
    belongs to the range it starts in and is joined across the cut. ``block`` is the start of the
    range, ``octets`` the length of the line in the file. Only a line feed ends a line. A byte order
    mark is not part of the first line, compressed files are read as one range. The line itself must fit in memory.
    """
    root = root.rstrip("/")
    reader = spark.readStream if stream else spark.read
    raw = reader.option("recursiveFileLookup", "true").option("lineSep", "\n").format("text").schema("value string").load(root)
    return _chosen(raw, root, include, exclude, max_size).select(
        _name(root).alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.make_valid_utf8("value").alias("text"),
        F.octet_length("value").cast("long").alias("octets"),
    )


_NUMBERED = pa.schema(
    [
        ("file", pa.string()), ("size", pa.int64()), ("block", pa.int64()), ("row", pa.int64()), ("text", pa.string()),
        ("lines", pa.int64()), ("octets", pa.int64()),
    ]
)


def _counted(lines: DataFrame, matcher: Matcher | None) -> DataFrame:
    """The lines a matcher may find something in, with their place in their range, and per range its number of lines and bytes."""

    def marker(file: str, size: int, block: int, rows: int, octets: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [{"file": file, "size": size, "block": block, "lines": rows, "octets": octets}], schema=_NUMBERED
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        rows = octets = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column("block").to_numpy()
            file = batch.column("file").dictionary_encode().indices.to_numpy()
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(file) != 0)) + 1
            at = np.zeros(len(block), np.int64)
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
                own = tuple(batch.column(c)[a].as_py() for c in ("file", "size", "block"))
                if own != key:
                    if key is not None:
                        yield marker(*key, rows, octets)
                    key, rows, octets = own, 0, 0
                at[a:b] = np.arange(rows, rows + b - a)
                rows += b - a
                octets += pc.sum(batch.column("octets").slice(a, b - a)).as_py() + b - a
            texts = batch.column("text")
            slow = matcher is None or None in matcher.regexes
            wanted = pa.array(np.ones(len(at), bool)) if slow else matcher.suspects(texts)
            kept = [pc.filter(batch.column(c), wanted) for c in ("file", "size", "block")]
            numbers, texts = pc.filter(pa.array(at), wanted), pc.filter(texts, wanted)
            nothing = pa.nulls(len(texts), pa.int64())
            if len(texts):
                yield pa.RecordBatch.from_arrays([*kept, numbers, texts, nothing, nothing], schema=_NUMBERED)
        if key is not None:
            yield marker(*key, rows, octets)

    ship_package(lines.sparkSession)
    schema = "file string, size long, block long, row long, text string, lines long, octets long"
    return lines.mapInArrow(count, schema)


def number_lines(lines: DataFrame, matcher: Matcher | None = None) -> DataFrame:
    """``file, size, line, text``: the lines of ``read_lines`` with their number in the file, from 1.

    With a matcher only the lines that it may find something in are kept. One pass reads the text; it counts
    the lines of every byte range, and a prefix sum over the ranges of a file gives each its first
    number. What it keeps is written once to the shared scratch folder. A carriage return before a line feed is no part of a line.
    """
    passed = stored(_counted(lines, matcher), "lines")
    of_file = Window.partitionBy("file")
    ranges = passed.where("row is null").select(
        "file",
        "block",
        (F.sum("lines").over(of_file.orderBy("block")) - F.col("lines")).alias("before"),
        F.sum("lines").over(of_file).alias("total"),
        F.sum("octets").over(of_file).alias("read"),
    )
    line = F.col("before") + F.col("row") + 1
    # The last line has no line feed if one byte more was read than the file has, counting one for each line.
    open_end = (line == F.col("total")) & F.col("read").isin(F.col("size") + 1, F.col("size") - 2)
    cut = F.when(F.col("text").endswith("\r") & ~open_end, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    found = passed.where("row is not null").select("file", "size", "block", "row", "text")
    return found.join(ranges, ["file", "block"]).select("file", "size", line.alias("line"), cut.alias("text"))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else "\\" + c for c in text)


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a saved commit log, one row per line with its position in the file."""
    return spark.read.text(path).select(F.col("value").alias("line"))


def parse_git_log(lines: DataFrame, column: str = "line") -> DataFrame:
    """Split ``hash|subject|author|date|refs`` lines; absent parts become ``''``.

    The split is on every bar, so a bar inside a subject moves the later parts.
    """
    parts = F.split(F.col(column), "[|]")
    names = ["hash", "subject", "author", "commit_date"]
    rest = [c for c in lines.columns if c != column]
    return lines.select(
        *rest,
        *[F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)],
    )
