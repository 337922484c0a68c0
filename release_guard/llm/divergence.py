"""How the words of each source differ from the other sources of its language.

Pointer sort: for every Arrow batch the word starts of all texts are pointers into the buffer of
bytes. They are sorted by group and then by the bytes they point at, eight bytes as one digit, and only runs
of equal digits with bytes left are sorted by the next digit (multikey quicksort on 64-bit digits).
A run of equal words of one group gives its occurrences and, as pointers stay in the order of the texts, its
documents. Spark adds up the runs of all batches, combined within each task before the shuffle.

All numbers are exact integers. Distances between sources are summed over blocks of a bounded number of
cells (terms times sources), so that no task holds more than a block of a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import text_or_empty

# Bytes of words: ASCII letters and all bytes of other characters; capitals A-Z become small.
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
# Digits compared before the rest of a word is compared as a whole.
DIGITS = 5
# Terms times sources of a block, and sources whose distances one task works out.
CELLS = 1 << 18
ROWS = 512
ONE = 1_000_000_000
PRIOR = 5


def word_pointers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in small letters, and per word its start, its length and the row it is in."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    size = int(ends[-1])
    raw = np.frombuffer(data, np.uint8, size) if size else np.zeros(0, np.uint8)
    inside = IS_WORD[raw]
    inside[: int(ends[0])] = False
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    # Texts lie one after the other; a word ends with its text.
    edges = ends[(ends > 0) & (ends < size)]
    starts[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    first = np.flatnonzero(starts)
    length = np.flatnonzero(stops) + 1 - first
    row = np.searchsorted(ends, first, side="right") - 1
    return LOWER[raw], first, length, row


def digits(data: np.ndarray, first: np.ndarray, length: np.ndarray, k: int) -> np.ndarray:
    """Bytes 8k to 8k+7 of the words as one big-endian number, zero beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    total = np.zeros(len(first), np.uint64)
    for i in range(8 * k, 8 * k + 8):
        there = i < length
        total = (total << np.uint64(8)) | np.where(there, padded[np.where(there, first + i, 0)], 0).astype(np.uint64)
    return total


def sorted_runs(
    data: np.ndarray, first: np.ndarray, length: np.ndarray, group: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The order of the pointers by group and word, and the places where another word or group starts.

    Pointers to equal words of a group keep their order.
    """
    n = len(first)
    key = digits(data, first, length, 0)
    order = np.lexsort((key, group))
    key, of = key[order], group[order]
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    for k in range(1, DIGITS + 1):
        run = np.cumsum(new) - 1
        alone = np.bincount(run, minlength=run[-1] + 1 if n else 0) == 1
        open_ = np.flatnonzero((length[order] > 8 * k) & ~alone[run])
        if not len(open_):
            break
        # Words that end here have the smallest digit, 0, and already stand before the longer ones of their run.
        at = order[open_]
        if k < DIGITS:
            part = digits(data, first[at], length[at], k)
        else:
            rest = [data[f + 8 * k : f + m].tobytes() for f, m in zip(first[at].tolist(), length[at].tolist(), strict=True)]
            rank = {word: i for i, word in enumerate(sorted(set(rest)))}
            part = np.fromiter((rank[word] for word in rest), np.uint64, len(rest))
        ended = length[order] <= 8 * k
        # Within a run: the ended words first, then the others by the digit; both in their old order.
        digit = np.zeros(n, np.uint64)
        digit[open_] = part
        whole = np.isin(run, run[open_], assume_unique=False)
        touched = np.flatnonzero(whole)
        again = touched[np.lexsort((digit[touched], ~ended[touched], run[touched]))]
        moved, moved_digit, moved_end = order[again], digit[again], ended[again]
        order[touched], digit[touched] = moved, moved_digit
        same_run = run[touched]
        fresh = np.ones(len(touched), bool)
        fresh[1:] = (
            (same_run[1:] != same_run[:-1]) | (moved_digit[1:] != moved_digit[:-1]) | (moved_end[1:] != moved_end[:-1])
        )
        new[touched] |= fresh
    return order, np.flatnonzero(new)


def batch_counts(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """Occurrences and documents of each word of each (lang, source) of a batch of (lang, source, text); None without words."""
    langs, sources = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
    of = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    data, first, length, row = word_pointers(batch.column(2))
    if not len(first):
        return None
    order, starts = sorted_runs(data, first, length, of[row])
    occurrences = np.diff(np.append(starts, len(order)))
    in_row = row[order]
    other = np.ones(len(order), bool)
    other[1:] = in_row[1:] != in_row[:-1]
    other[starts] = True
    documents = np.add.reduceat(other.astype(np.int64), starts)
    head = order[starts]
    sizes = length[head]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    places = np.arange(ends[-1]) + np.repeat(first[head] - ends[:-1], sizes)
    terms = pa.Array.from_buffers(
        pa.large_string(), len(head), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[places].tobytes())]
    ).cast(pa.string())
    lang, source = np.divmod(of[row[head]], len(sources.dictionary))
    return pa.RecordBatch.from_arrays(
        [
            langs.dictionary.take(pa.array(lang)), sources.dictionary.take(pa.array(source)), terms,
            pa.array(occurrences, pa.int64()), pa.array(documents, pa.int64()),
        ],
        names=["lang", "source", "term", "n", "df"],
    )


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents of every term of every source.

    Null text, lang and source count as ''. Rows of a repeated id are documents of their own.
    """
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], text_or_empty().alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch_counts(batch)
            if found is not None:
                yield found

    runs = read.mapInArrow(count, "lang string, source string, term string, n long, df long")
    return runs.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), exact; null for a language without terms."""
    above = f"cast({ONE} as decimal(20,0)) * cast({count} + {PRIOR} as decimal(18,0))"
    below = f"nullif({total} + {PRIOR} * {terms}, 0)"
    return F.expr(f"1 + ({above} div cast({below} as decimal(38,0)))")


def block_distances(key: tuple, table: pa.Table) -> pa.Table:
    """Sums of absolute differences between sources over the terms of one block of a language.

    Rows with a term hold a share, rows without one the share of terms that a source lacks.
    """
    lang, _, band = (value.as_py() for value in key)
    source = np.array(table.column("source").to_pylist(), dtype=object)
    term = table.column("term").combine_chunks().dictionary_encode()
    value = table.column("p").to_numpy()
    base = term.is_null().to_numpy(zero_copy_only=False)
    names = source[base]
    place = {name: i for i, name in enumerate(names)}
    cells = np.repeat(value[base][:, None], len(term.dictionary), axis=1)
    held = ~base
    rows = np.fromiter((place[s] for s in source[held]), np.int64, int(held.sum()))
    cells[rows, term.indices.to_numpy(zero_copy_only=False)[held].astype(np.int64)] = value[held]
    mine = np.flatnonzero(table.column("band").to_numpy()[base] == band)
    sums = [np.abs(cells - cells[i]).sum(axis=1) for i in mine]
    others = [np.delete(np.arange(len(names)), i) for i in mine]
    picked = np.concatenate(others) if others else np.zeros(0, np.int64)
    total = np.concatenate([s[o] for s, o in zip(sums, others, strict=True)]) if others else np.zeros(0, np.int64)
    own = np.repeat(mine, len(names) - 1)
    return pa.table(
        {
            "lang": pa.array([lang] * len(own), pa.string()),
            "source": pa.array(names[own].tolist(), pa.string()),
            "item": pa.array(names[picked].tolist(), pa.string()),
            "value": pa.array(total, pa.int64()),
        }
    )


def source_divergence(docs: DataFrame, least_documents: int = 30, best: int = 50, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): distance of each source to each other one, and its most typical terms.

    Kept are the terms in at least `least_documents` documents of a language. Part `pair` has the sum over kept terms of
    |p - q| for every other source of the language, part `term` the `best` kept terms that are more frequent than in
    the language. Ties are ranked by item. A language without kept terms has pairs of value 0, one of
    a single source has none, an empty table gives no rows.
    """
    counted = term_counts(docs).withColumn("documents", F.sum("df").over(Window.partitionBy("lang", "term")))
    kept = stored(counted.where(F.col("documents") >= least_documents).select("lang", "source", "term", "n"), "kept-terms")
    null_free = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    terms = kept.groupBy("lang", "term").agg(F.sum("n").alias("all_n"))
    of_lang = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("all_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(*null_free).distinct().join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left")
    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    groups = groups.join(sources, "lang").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"),
        F.coalesce("all_total", F.lit(0)).alias("all_total"),
        F.greatest(F.lit(1), F.ceil(F.coalesce("v", F.lit(0)) * F.col("sources") / cells)).cast("long").alias("blocks"),
        F.ceil(F.col("sources") / ROWS).cast("long").alias("bands"),
    )
    groups = stored(groups, "source-groups")

    shares = kept.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "v"))
    block = F.pmod(F.xxhash64("term"), F.col("blocks"))
    own_band = F.pmod(F.xxhash64("source"), F.col("bands"))
    every_band = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bands") - 1)).alias("for")
    held = shares.select("lang", "source", "term", "p", block.alias("block"), own_band.alias("band"), every_band)
    absent = groups.withColumn("n", F.lit(0).cast("long")).select(
        "lang", "source", F.lit(None).cast("string").alias("term"), F.coalesce(share("n", "total", "v"), F.lit(0)).alias("p"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "bands",
    )
    absent = absent.select("lang", "source", "term", "p", "block", own_band.alias("band"), every_band)
    part = held.union(absent).groupBy("lang", "block", "for")
    sums = part.applyInArrow(block_distances, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    typical = shares.join(terms, ["lang", "term"]).withColumn("q", share("all_n", "all_total", "v"))
    typical = typical.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = [
        pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order)),
        typical.withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best),
    ]
    columns = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return ranked[0].select(*columns).unionByName(ranked[1].select(*columns))
