"""Removal of long byte strings that occur more than once, by bucket-pointer refinement.

Every position of a text has a bucket pointer: the identifier of the bucket its first q
bytes fall into. Pointers are derived from content, so that all tasks agree on them
without ranks. A bucket of depth d is refined by the pointer d bytes further on, which gives depth 2d, and
the refined pointers are used again for the next step, up to the full length. Refinement
only goes on where a bucket holds more than one position:

1. Every window of the full length picks the position in it whose pointer of depth `gram` is smallest. Equal
   windows pick the same place, so the picked positions, a few for a hundred bytes, stand for all. Their
   buckets are formed; a bucket of one position is final, no window through it repeats.
2. Consecutive windows with the same pick are a run. Buckets are refined by the pointers at both ends
   of the run; runs that are equal as a whole repeat in all their windows. Open are the runs that stay alone
   in a bucket with others, and one of each group of equal ones beside them.
3. Open runs are cut into chunks at fixed distances from the pick, and refined by the bytes all windows of a chunk
   share: their core, two pointers of half depth. The same rule settles equal chunks and leaves others open.
4. In open chunks every single window is refined to the full length by the few bytes around the core, and windows
   whose bucket holds several positions repeat.

Groups of equal runs, chunks or windows are counted with combination before the shuffle and are
never collected, so a passage in a third of all texts costs as much as any other bytes.
Pointers have 64 bits; a window must agree in the pointers of two depths to count as equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import text_or_empty
from .jaccard import mixed

# Windows handled at once; a longer text is cut into such parts, which overlap.
PART = 1 << 18
ODD = 0x2545F4914F6CDD1D


@cache
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    both = []
    for base in (ODD, pow(ODD, -1, 1 << 64)):
        steps = np.full(length, base, np.uint64)
        steps[0] = 1
        both.append(np.cumprod(steps, dtype=np.uint64))
    return both[0], both[1]


@cache
def _byte_codes() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD))


class Windows:
    """Bucket pointers of all positions of a byte string, by depth."""

    def __init__(self, data: np.ndarray, length: int, gram: int):
        power, inverse = _powers(1 << max(12, len(data).bit_length()))
        q = length // 8
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_codes()[data] * power[: len(data)], out=sums[1:])
        pointer = mixed((sums[q:] - sums[:-q]) * inverse[: len(data) - q + 1])
        depth = q
        self.gram = None
        while depth < length:
            self.half, self.half_depth = pointer, depth
            if depth >= gram and self.gram is None:
                self.gram, self.gram_depth = pointer, depth
            step = min(depth, length - depth)
            pointer = mixed(pointer[:-step] * np.uint64(3) ^ pointer[step:])
            depth += step
        self.full = pointer

    def picks(self) -> np.ndarray:
        """For each window the place of its smallest gram pointer, the first of equal ones."""
        span = len(self.gram) - len(self.full) + 1
        value, place = self.gram, np.arange(len(self.gram), dtype=np.int32)
        width = 1
        while width < span:
            step = min(width, span - width)
            later = value[step:] < value[:-step]
            value = np.where(later, value[step:], value[:-step])
            place = np.where(later, place[step:], place[:-step])
            width += step
        return place

    def runs(self) -> tuple[np.ndarray, ...]:
        """Bucket, run pointer, first window, number of windows and distance of the pick of each run."""
        place = self.picks()
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        last = np.concatenate([first[1:], [len(place)]]) - 1
        pick = place[first]
        shape = (pick - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)
        run = mixed(mixed(self.full[first] ^ mixed(shape)) * np.uint64(3) ^ self.full[last])
        return self.gram[pick], run, first, last - first + 1, pick - first

    def core(self, at: np.ndarray, depth: int) -> np.ndarray:
        """Pointers of a depth between the half and the whole one."""
        return mixed(self.half[at] * np.uint64(5) ^ self.half[at + depth - self.half_depth])


def parts(data: bytes, length: int, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Overlapping parts of a byte string, so that every window lies in one of them."""
    whole = np.frombuffer(data, np.uint8)
    for start in range(0, len(data) - length + 1, size):
        yield start, whole[start : start + size + length - 1]


def repeated_here(bucket: np.ndarray, run: np.ndarray, first: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which runs must be compared with other texts, and what the others cover, as (first window, number).

    Of equal runs of a text two are enough to settle all of them, here and elsewhere, so the third and later ones need no
    comparison. In periodic text, where every window may be a run of its own, nearly all are such, and as
    they adjoin they make few stretches.
    """
    order = np.lexsort((bucket, run))
    new = np.ones(len(order), bool)
    new[1:] = (run[order][1:] != run[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    compared = np.ones(len(order), bool)
    compared[order] = np.arange(len(order)) - start < 2
    begin, end = first[~compared], first[~compared] + windows[~compared]
    if not len(begin):
        return compared, []
    cut = np.flatnonzero(begin[1:] > end[:-1]) + 1
    return compared, list(zip(begin[np.append(0, cut)].tolist(), (end[np.append(cut - 1, len(end) - 1)] - begin[np.append(0, cut)]).tolist(), strict=True))


def _runs(docs: DataFrame, length: int, gram: int, part_size: int) -> DataFrame:
    """bucket, run, doc, first window, number of windows and distance of the pick of every run.

    A distance of -1 marks a stretch of windows that are repeated within their text, under the bucket of their text.
    """
    names = ["bucket", "run", "doc", "first", "windows", "lead"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes()
                for start, part in parts(data, length, part_size):
                    bucket, run, first, windows, lead = Windows(part, length, gram).runs()
                    compared, stretches = repeated_here(bucket, run, first, windows)
                    own = tuple(x[compared] for x in (bucket.view(np.int64), run.view(np.int64), first + start, windows, lead))
                    held.append((*own[:2], np.full(len(own[0]), doc), *own[2:]))
                    if stretches:
                        n = len(stretches)
                        begin, count = (np.array(x, np.int64) for x in zip(*stretches, strict=True))
                        held.append((np.full(n, doc), np.zeros(n, np.int64), np.full(n, doc), begin + start, count, np.full(n, -1)))
                    size += len(own[0])
                if size > 100_000:
                    yield _batch(names, held)
                    held, size = [], 0
            if held:
                yield _batch(names, held)

    return docs.select("doc", "text").mapInArrow(emit, "bucket long, run long, doc long, first long, windows long, lead long")


def _batch(names: list[str], held: list[tuple]) -> pa.RecordBatch:
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*held, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


CHUNK = pa.schema(
    [*((n, pa.int64()) for n in ("bucket", "core", "doc", "first", "windows", "whole")), ("left", pa.binary()), ("right", pa.binary())]
)


def _chunks(flagged: DataFrame, length: int, gram: int, part_size: int) -> DataFrame:
    """The chunks of open runs: bucket, core, doc, first window, windows, the bytes beside the core, a hash of these.

    `flagged` has doc, text and open, the runs to look at as (bucket, first, windows, lead).
    """
    step = max(1, length // 12)
    depth = length - step + 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                by_part: dict[int, list] = {}
                for r in runs:
                    by_part.setdefault(r["first"] // part_size * part_size, []).append(r)
                for start, part in parts(data, length, part_size):
                    if start not in by_part:
                        continue
                    pointers = Windows(part, length, gram)
                    own = []
                    for r in by_part[start]:
                        pick, far, near = r["first"] + r["lead"], r["lead"], r["lead"] - r["windows"] + 1
                        for k in range(near // step, far // step + 1):
                            first, last = pick - min(far, step * k + step - 1), pick - max(near, step * k)
                            own.append((r["bucket"], pick - step * k, first, last))
                    cores = pointers.core(np.array([c[1] for c in own]) - start, depth).view(np.int64).tolist()
                    for (bucket, at, first, last), core in zip(own, cores, strict=True):
                        left, right = data[first:at], data[at + depth : last + length]
                        whole = xxhash.xxh3_64_intdigest(left + right, seed=step * len(left) + last - first) - (1 << 63)
                        rows.append((bucket, core, doc, first, last - first + 1, whole, left, right))
                if len(rows) > 50_000:
                    yield _rows(rows, CHUNK)
                    rows = []
            if rows:
                yield _rows(rows, CHUNK)

    ddl = "bucket long, core long, doc long, first long, windows long, whole long, left binary, right binary"
    return flagged.select("doc", "text", "open").mapInArrow(emit, ddl)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _window_hits(chunks: DataFrame) -> DataFrame:
    """doc and first byte of the windows of open chunks that occur more than once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64()) for n in ("bucket", "core", "window", "doc", "first")])
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.to_pylist():
                left, right, n = r["left"], r["right"], r["windows"]
                for j in range(n):
                    sides = left[j:] + right[: len(right) - (n - 1 - j)]
                    window = xxhash.xxh3_64_intdigest(sides, seed=len(left) - j) - (1 << 63)
                    rows.append((r["bucket"], r["core"], window, r["doc"], r["first"] + j))
            if rows:
                yield _rows(rows, schema)

    names = ["bucket", "core", "doc", "first", "windows", "left", "right"]
    windows = chunks.select(*names).mapInArrow(emit, "bucket long, core long, window long, doc long, first long")
    place = ["bucket", "core", "window"]
    several = windows.groupBy(place).agg(F.count("*").alias("n")).where("n > 1").select(place)
    return windows.join(several, place).select("doc", "first")


def _refined(rows: DataFrame, group: list[str], whole: str) -> tuple[DataFrame, DataFrame]:
    """The rows equal to another one as a whole; and the open ones, which share only their group with others.

    Of equal rows beside open ones, one is open too, as a partner. All rows share their group.
    """
    equal = rows.groupBy(*group, whole).agg(F.count("*").alias("n"), F.min(F.struct("doc", "first")).alias("one"))
    lonely = equal.where("n = 1").select(group).distinct()
    opened = equal.join(lonely, group).select(*group, F.col("one.doc").alias("doc"), F.col("one.first").alias("first"))
    settled = rows.join(equal.where("n > 1").select(*group, whole), [*group, whole])
    return settled, rows.join(opened, [*group, "doc", "first"]).dropDuplicates([*group, "doc", "first"])


def without_repeats(
    df: DataFrame, length: int = 200, gram: int = 50, id_column: str = "doc_id", text: str = "text",
    keep_bytes: bool = False, part_size: int = PART,
) -> DataFrame:
    """Remove every byte covered by a `length`-byte string that starts at another place too.

    Texts are UTF-8 bytes; matches do not cross documents, may overlap and may lie in
    the same document; all are judged on the input. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256 of the remaining bytes and, with `keep_bytes`, these as `kept`. Null and short texts keep all
    they have. Rows of a repeated id are documents of their own; repeated rows repeat each other's text.
    """
    if not length // 8 <= gram < length:
        raise ValueError("gram must lie between an eighth of the length and the length")
    docs = df.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    docs = docs.withColumn("doc", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), "text"))
    runs = _runs(docs.where(F.octet_length("text") >= length), length, gram, part_size)

    several = runs.groupBy("bucket").agg(F.count("*").alias("n"), F.min("lead").alias("least"))
    several = several.where("n > 1 or least < 0").select("bucket")
    runs = stored(runs.join(several, "bucket"), "runs")
    settled, opened = _refined(runs.where("lead >= 0"), ["bucket"], "run")
    columns = ["doc", "bucket", "first", "windows", "lead"]
    settled = settled.select(*columns).unionByName(runs.where("lead < 0").select(*columns))
    marked = settled.withColumn("settled", F.lit(True)).unionByName(
        opened.select(*columns, F.lit(False).alias("settled"))
    )
    # The runs of one text; their number is bounded by its length.
    run = F.struct("bucket", "first", "windows", "lead")
    lists = marked.groupBy("doc").agg(
        F.collect_set(F.when(F.col("settled"), F.struct("first", "windows"))).alias("spans"),
        F.collect_set(F.when(~F.col("settled"), run)).alias("open"),
    )
    whole = docs.join(lists, "doc", "left")
    plain = F.col("spans").isNull()
    size = F.octet_length("text").cast("long").alias("n_bytes")
    whole = stored(
        whole.select(
            "doc_id", "doc", size, "spans", "open",
            F.when(plain, F.sha2(F.col("text").cast("binary"), 256)).alias("sha"),
            (F.col("text") if keep_bytes else F.when(~plain, F.col("text"))).alias("text"),
        ),
        "texts",
    )
    flagged = whole.where("spans is not null")
    # Repeated rows have open runs only as partners; that their chunks come twice settles nothing else.
    chunks = stored(_chunks(flagged.where(F.size("open") > 0), length, gram, part_size), "chunks")
    place = ["bucket", "core"]
    several = chunks.groupBy(place).agg(F.count("*").alias("n")).where("n > 1").select(place)
    chunks = stored(chunks.join(several, place), "shared-chunks")
    settled, opened = _refined(chunks, place, "whole")
    one = F.lit(1).cast("long").alias("windows")
    hits = settled.select("doc", "first", "windows").unionByName(_window_hits(opened).select("doc", "first", one))
    starts = hits.groupBy("doc").agg(F.collect_set(F.struct("first", "windows")).alias("hits"))
    marked = flagged.join(starts, "doc", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids, texts, spans, hits = (batch.column(i) for i in range(4))
            for doc_id, text, own, more in zip(ids.to_pylist(), texts, spans.to_pylist(), hits.to_pylist(), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                edge = np.zeros(len(data) + 1, np.int64)
                for s in own + (more or []):
                    edge[s["first"]] += 1
                    edge[s["first"] + s["windows"] - 1 + length] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                kept = data[~gone].tobytes()
                n_spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]) if len(gone) else 0
                rows.append(
                    (doc_id, len(data), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()) + (kept,) * keep_bytes
                )
            fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())]
            fields += [("kept_sha256", pa.string())] + [("kept", pa.binary())] * keep_bytes
            if rows:
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    changed = marked.select("doc_id", "text", "spans", "hits").mapInArrow(cut, ddl)
    zero = F.lit(0).cast("long")
    unchanged = whole.where("spans is null").select(
        "doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"),
        *[F.col("text").cast("binary").alias("kept")] * keep_bytes,
    )
    return changed.unionByName(unchanged)
