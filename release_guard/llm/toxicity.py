"""Toxic passages by maximum-scoring segments.

Every word gets the log-odds of toxic against clean documents, estimated with a chain of Dirichlet
priors: the rate of a word is shrunk towards the rate of its first five characters, that towards the
first four, the first three and all words, so that unseen forms of a known stem still count. Less a
fixed drift, these scores are negative in clean text. A linear-time scan (Ruzzo and Tompa) finds all
maximal-scoring segments of a text. For clean text the best score M of n words follows
an extreme-value law P(M <= x) = exp(-K n e^(-lambda x)); lambda and K are fitted on clean documents, the
passages of a document are aggregated by the sum statistic of Karlin and Altschul, and a logistic curve
over its logarithm gives the probability of the label.

Words are counted once a document, over all labelled documents with different texts, in tables of hashed buckets of
a fixed size: whatever the input, the model has the same size, and rare words that share a bucket
dilute it alike. One part of the labelled documents teaches the words, another one the calibration.
Texts are read whole; the scan is narrow, only labelled texts are shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_groups, text_or_empty

WORD = re.compile(r"[^\W\d_]+")
# Leading characters and buckets of each level of the chain; the last level is the whole word.
LEVELS = [(3, 1 << 16), (4, 1 << 17), (5, 1 << 18), (None, 1 << 19)]
OFFSETS = np.cumsum([0, *[size for _, size in LEVELS]])
# Words a Python worker remembers, characters of text it handles at once.
REMEMBERED = 200_000
BATCH_CHARS = 1 << 20
# Candidate values for lambda.
GRID = [round(0.05 * 1.08**i, 6) for i in range(64)]
STEP = 0.25
# Of the passages of a text these count: the best one, and others with a score above this.
RELEVANT = 2.0
LOWEST, HIGHEST = -20.0, 60.0
PASSAGE = "array<struct<start:long,end:long,score:double>>"
PASSAGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def buckets(word: str) -> list[int]:
    """The bucket of a word on each level."""
    found = []
    for (length, size), offset in zip(LEVELS, OFFSETS, strict=False):
        found.append(int(offset) + zlib.crc32(word[:length].encode("utf-8", "surrogatepass")) % size)
    return found


@dataclass
class Lexicon:
    """Toxic and all documents per bucket, the share of toxic words, and how they become the score of a word."""

    toxic: np.ndarray
    total: np.ndarray
    base: float
    strength: float
    drift: float
    most: float = 6.0

    def score(self, word: str) -> float:
        """Log-odds of a word against all words, less the drift."""
        rate = self.base
        for bucket in buckets(word):
            rate = (self.toxic[bucket] + self.strength * rate) / (self.total[bucket] + self.strength)
        odds = log(rate / (1 - rate)) - log(self.base / (1 - self.base))
        return max(-self.most, min(self.most, odds)) - self.drift


@dataclass
class Calibration:
    """The extreme-value law of clean text and the curve from its logarithm to a probability."""

    scale: float
    constant: float
    intercept: float
    slope: float

    def score(self, words: int, scores: list[float]) -> float:
        """Probability of label 1 for a text of so many words with passages of these scores."""
        found = evidence(words, scores, self.scale, self.constant) if words else LOWEST
        return 1 / (1 + exp(-self.intercept - self.slope * found))


def relevant(scores: list[float], least: float = RELEVANT) -> list[bool]:
    """Which passages of a text count."""
    best = max(scores, default=0.0)
    return [score > least or score == best for score in scores]


def learn_lexicon(
    labelled: DataFrame, text: str = "text", label: str = "toxic", strength: float = 10.0, drift: float = 1.0
) -> Lexicon | None:
    """Count words in rows with a text and a label 0 or 1; other rows are left out.

    Copies of a text with the same label count once, so that a large group of copies teaches no
    more than one document. None without documents of both labels.
    """
    known = labelled.select(text_or_empty(text).alias("text"), F.col(label).cast("int").alias("toxic"))
    known = known.where("toxic in (0, 1) and text <> ''")
    known = known.withColumn("same", F.md5(F.col("text").cast("binary"))).dropDuplicates(["same", "toxic"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, OFFSETS[-1]), np.int64)
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for own, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                every: set[int] = set()
                for word in set(WORD.findall(own.lower())):
                    places = seen.get(word)
                    if places is None:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        places = seen[word] = buckets(word)
                    every.update(places)
                counts[toxic, np.fromiter(every, np.int64, len(every))] += 1
        used = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array(counts[1, used]), pa.array(counts[0, used])],
            names=["bucket", "toxic", "clean"],
        )

    counted = known.select("text", "toxic").mapInArrow(count, "bucket long, toxic long, clean long")
    table = counted.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    toxic, clean = np.zeros(OFFSETS[-1], np.float32), np.zeros(OFFSETS[-1], np.float32)
    place = table.column("bucket").to_numpy()
    toxic[place], clean[place] = table.column("toxic").to_numpy(), table.column("clean").to_numpy()
    words = slice(int(OFFSETS[-2]), None)
    sums = toxic[words].sum(dtype=float), clean[words].sum(dtype=float)
    if not sums[0] or not sums[1]:
        return None
    return Lexicon(toxic, toxic + clean, sums[0] / (sums[0] + sums[1]), strength, drift)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments as (first, end, score), in linear time.

    Neighbouring positive scores are joined first; ties are left as the shorter segment.
    """
    positive = scores > 0
    edges = np.flatnonzero(np.diff(positive, prepend=False, append=False))
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=float)])
    left: list[float] = []
    right: list[float] = []
    first: list[int] = []
    end: list[int] = []
    before: list[int] = []
    for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        low, high = float(sums[start]), float(sums[stop])
        j = len(left) - 1
        while True:
            # The nearest earlier segment that starts lower; the chain skips those that do not.
            while j >= 0 and left[j] >= low:
                j = before[j]
            if j < 0 or right[j] >= high:
                break
            low, start = left[j], first[j]
            after, j = j, before[j]
            for kept in (left, right, first, end, before):
                del kept[after:]
        left.append(low)
        right.append(high)
        first.append(start)
        end.append(stop)
        before.append(j)
    return [(a, b, high - low) for a, b, low, high in zip(first, end, left, right, strict=True)]


class Scanner:
    """Finds the segments of many texts and remembers the scores of their words."""

    def __init__(self, lexicon: Lexicon | None) -> None:
        self.lexicon = lexicon
        self.known: dict[str, float] = {}

    def scan(self, texts: list[str]) -> tuple[list[int], list[list[tuple[int, int, float]]]]:
        """Words and maximal segments of each text."""
        words = [WORD.findall(t.lower()) for t in texts]
        counts = list(map(len, words))
        if self.lexicon is None:
            return counts, [[] for _ in words]
        new = set().union(*words).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*words)
        self.known.update((w, self.lexicon.score(w)) for w in new)
        found = []
        for own in words:
            scores = np.fromiter(map(self.known.__getitem__, own), np.float64, len(own))
            found.append(maximal_segments(scores) if (scores > 0).any() else [])
        return counts, found


def _scanned(df: DataFrame, lexicon: Lexicon | None, text: str, out: dict[str, str], columns) -> DataFrame:
    """Add the columns `out`, made by `columns(words, segments)` from the words and segments of some texts."""
    names = [f.name for f in df.schema.fields if f.name not in out]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in row_groups(map(len, texts), BATCH_CHARS):
                made = columns(*scanner.scan(texts[a:b]))
                kept = [c.slice(a, b - a) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*names, *out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names]
    schema = ", ".join([*fields, *[f"{name} {kind}" for name, kind in out.items()]])
    return df.select(*[f"`{n}`" for n in names], text_or_empty(text).alias("text read")).mapInArrow(scan, schema)


def score_passages(df: DataFrame, lexicon: Lexicon | None, text: str = "text", least: float = RELEVANT) -> DataFrame:
    """Add n_words and passages: the best maximal segment and all others with a score above `least`, as (start, end, score).

    start and end are words, counted from 0, end exclusive; `passage_places` turns them into characters. A null or
    empty text, or one without letters, has 0 words and no passages, as has any text without a lexicon. Columns of these
    names are replaced.
    """

    def columns(words: list[int], segments: list) -> list[pa.Array]:
        counts = [relevant([v for *_, v in own], least) for own in segments]
        kept = [
            [{"start": s, "end": e, "score": v} for (s, e, v), counted in zip(own, marks, strict=True) if counted]
            for own, marks in zip(segments, counts, strict=True)
        ]
        return [pa.array(words, pa.int64()), pa.array(kept, PASSAGES)]

    return _scanned(df, lexicon, text, {"n_words": "long", "passages": PASSAGE}, columns)


def score_texts(df: DataFrame, lexicon: Lexicon | None, calibration: Calibration | None, text: str = "text") -> DataFrame:
    """Add score, the probability of label 1, from 0 to 1; narrow, nothing but the texts is read.

    0 for all texts without a lexicon and a calibration. A column of this name is replaced.
    """

    def columns(words: list[int], segments: list) -> list[pa.Array]:
        if calibration is None:
            return [pa.array([0.0] * len(words))]
        return [pa.array([calibration.score(n, [v for *_, v in own]) for n, own in zip(words, segments, strict=True)], pa.float64())]

    return _scanned(df, lexicon, text, {"score": "double"}, columns)


def passage_places(text: str, passages: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """First and end character of passages given in words; for text whose lower case keeps its length."""
    places = [m.span() for m in WORD.finditer(text.lower())]
    return [(places[s][0], places[e - 1][1]) for s, e in passages]


def evidence(words: int, scores: list[float], scale: float, constant: float) -> float:
    """Minus the logarithm of the chance to find passages like these in clean text of so many words.

    The least chance over the r best passages together, for every r, with a factor of 2 for each passage more. Only
    ``relevant`` passages count.
    """
    space = log(constant * max(words, 1))
    scores = [score for score, counted in zip(scores, relevant(scores), strict=True) if counted]
    best = total = -space
    for r, score in enumerate(sorted(scores, reverse=True), 1):
        total = scale * score - space if r == 1 else total + scale * score - space
        chance = total - (r - 1) * log(max(total, 1.0)) + lgamma(r + 1) + lgamma(r) - (r - 1) * log(2)
        if r > 1 and scale * score <= space:
            break
        best = max(best, chance)
    return max(LOWEST, min(HIGHEST, best))


def add_evidence(scored: DataFrame, scale: float, constant: float) -> DataFrame:
    """Replace the column passages by evidence; without words the lowest."""
    names = [c for c in scored.columns if c not in ("passages", "evidence")]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema.fields if f.name in names]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, every = batch.column("n_words").to_pylist(), batch.column("passages").to_pylist()
            found = [
                evidence(n, [p["score"] for p in own], scale, constant) if n else LOWEST
                for n, own in zip(words, every, strict=True)
            ]
            columns = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.float64())], names=[*names, "evidence"])

    return scored.mapInArrow(weigh, ", ".join([*fields, "evidence double"]))


def fit_law(scored: DataFrame) -> tuple[float, float]:
    """lambda and K of clean rows with n_words and passages, by greatest likelihood.

    One aggregation evaluates the equation for lambda on a grid; K follows from lambda.
    """
    best = F.coalesce(F.array_max(F.transform("passages", lambda p: p["score"])), F.lit(0.0))
    rows = scored.where("n_words > 0").select(best.alias("m"), F.col("n_words").cast("double").alias("n"))
    sums: list[Column] = [F.count("*").alias("rows"), F.avg("m").alias("mean")]
    for i, scale in enumerate(GRID):
        weight = F.col("n") * F.exp(-scale * F.col("m"))
        sums += [F.sum(weight).alias(f"w{i}"), F.sum(weight * F.col("m")).alias(f"v{i}")]
    found = rows.agg(*sums).first()
    if not found["rows"]:
        return 1.0, 1.0
    # The derivative falls as lambda grows; its root is the estimate, the ends stand for none inside the grid.
    slopes = [1 / s - found["mean"] + found[f"v{i}"] / found[f"w{i}"] for i, s in enumerate(GRID)]
    at = next((i for i, slope in enumerate(slopes) if slope <= 0), len(GRID) - 1)
    return GRID[at], found["rows"] / found[f"w{at}"]


def calibrate(scored: DataFrame, label: str = "toxic") -> Calibration:
    """Fit the extreme-value law on rows of label 0 and the curve on rows of labels 0 and 1.

    The rows need n_words and passages; they should be others than those of the lexicon.
    """
    known = scored.where(F.col(label).isin(0, 1)).select(F.col(label).alias("toxic"), "n_words", "passages")
    scale, constant = fit_law(known.where("toxic = 0"))
    bins = F.round(F.col("evidence") / STEP).cast("int").alias("bin")
    counted = add_evidence(known, scale, constant).groupBy(bins).agg(
        F.sum("toxic").cast("double").alias("toxic"), F.count("*").cast("double").alias("rows")
    )
    rows = sorted(tuple(r) for r in counted.collect())
    x = np.array([r[0] for r in rows], float) * STEP / 10
    toxic, total = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    # Newton steps of a logistic regression with a weak Gaussian prior, which keeps separable classes finite.
    weights = np.zeros(2)
    design = np.stack([np.ones(len(x)), x], axis=1)
    for _ in range(50):
        rate = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (toxic - total * rate) - 0.01 * weights
        curve = (design * (total * rate * (1 - rate))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        weights = weights + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return Calibration(scale, constant, float(weights[0]), float(max(weights[1], 0.0) / 10))


def significant(scored: DataFrame, calibration: Calibration, expected: float = 0.05) -> DataFrame:
    """Keep of the passages those of which clean text of this length would show fewer than `expected`."""
    space = F.lit(calibration.constant) * F.col("n_words")
    return scored.withColumn(
        "passages",
        F.filter("passages", lambda p: space * F.exp(-calibration.scale * p["score"]) < expected),
    )
