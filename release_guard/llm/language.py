"""Language identification of mixed-language text.

The script of a word narrows the languages it can be in. Every word then gets a score per
language from the character n-grams it has, and the best sequence of languages, found with
the Viterbi algorithm under a penalty for each switch, labels the words. Runs of words with
one label are the spans; the language with most letters is that of the text.

The model is a table of counts: n-grams hashed into a fixed number of buckets, per
language, and the letters of each script. Spark counts, and only this table of bounded size comes to the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_groups, text_or_empty
from .jaccard import MIX, mixed

UNKNOWN = "und"
BUCKETS = 1 << 16
LONGEST_GRAM = 4
WORD = re.compile(r"[^\W\d_]+")
# Words whose scores a Python worker remembers; characters of text handled at once.
REMEMBERED = 200_000
BATCH_CHARS = 1 << 20
BATCH_WORDS = 25_000

# First and last code point of scripts; the rest, mostly Latin, is script 0.
SCRIPTS = [
    ("Greek", 0x0370, 0x03FF), ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0530, 0x058F), ("Hebrew", 0x0590, 0x05FF),
    ("Arabic", 0x0600, 0x077F), ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF), ("Gurmukhi", 0x0A00, 0x0A7F),
    ("Gujarati", 0x0A80, 0x0AFF), ("Tamil", 0x0B80, 0x0BFF), ("Telugu", 0x0C00, 0x0C7F), ("Kannada", 0x0C80, 0x0CFF),
    ("Malayalam", 0x0D00, 0x0D7F), ("Sinhala", 0x0D80, 0x0DFF), ("Thai", 0x0E00, 0x0E7F), ("Lao", 0x0E80, 0x0EFF),
    ("Tibetan", 0x0F00, 0x0FFF), ("Myanmar", 0x1000, 0x109F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF),
    ("Ethiopic", 0x1200, 0x139F), ("Khmer", 0x1780, 0x17FF), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x9FFF),
    ("Hangul", 0xAC00, 0xD7AF), ("Han", 0x20000, 0x2FA1F),
]
SCRIPT_NAMES = ["Latin", *dict.fromkeys(name for name, _, _ in SCRIPTS)]
_FIRST = np.array([first for _, first, _ in SCRIPTS])
_LAST = np.array([last for *_, last in SCRIPTS])
_SCRIPT = np.array([SCRIPT_NAMES.index(name) for name, _, _ in SCRIPTS])


def scripts(codes: np.ndarray) -> np.ndarray:
    """The number of each code point's script."""
    at = np.searchsorted(_FIRST, codes, side="right") - 1
    inside = (at >= 0) & (codes <= _LAST[at])
    return np.where(inside, _SCRIPT[at], 0)


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per position of the padded words and per length the bucket of the n-gram there (BUCKETS for none).

    Returns these, the first position of each word, and the code point of its first letter.
    """
    codes = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    left = np.repeat(ends, lengths) - np.arange(len(codes))
    found = np.full((LONGEST_GRAM, len(codes)), BUCKETS, np.int64)
    total = np.zeros(len(codes), np.uint64)
    for n in range(1, LONGEST_GRAM + 1):
        later = np.zeros(len(codes), np.uint64)
        later[: len(codes) - n + 1] = codes[n - 1 :]
        total = mixed(total * MIX[0] + later + np.uint64(n))
        if n > 1:
            found[n - 1] = np.where(left >= n, (total >> np.uint64(48)).astype(np.int64) % BUCKETS, BUCKETS)
    return found, starts, codes[starts + 1].astype(np.int64)


@dataclass
class Model:
    """Scores of n-gram buckets, and which languages use which script."""

    languages: list[str]
    scores: np.ndarray
    uses: np.ndarray


def learn(docs: DataFrame, per_language: int = 4000, text: str = "text", lang: str = "lang") -> Model:
    """Learn a model from rows with text and language.

    About `per_language` rows of a language are used, chosen by a hash of their content; each is used whole.
    The table of counts has BUCKETS numbers per language. Without rows there are no languages.
    """
    known = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where(
        "lang is not null and text is not null"
    )
    rows = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(rows)
    if not languages:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool))
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, per_language / rows[name]))])
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = {name: np.zeros(BUCKETS + 1, np.int64) for name in languages}
        letters = {name: np.zeros(len(SCRIPT_NAMES), np.int64) for name in languages}
        for batch in batches:
            by_language: dict[str, Counter] = {}
            for name, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_language.setdefault(name, Counter()).update(WORD.findall(own.lower()))
            for name, words in by_language.items():
                every, often = list(words), np.fromiter(words.values(), np.int64, len(words))
                for start in range(0, len(every), BATCH_WORDS):
                    times = often[start : start + BATCH_WORDS]
                    found, starts, first = gram_buckets(every[start : start + BATCH_WORDS])
                    spans = np.diff(np.append(starts, found.shape[1]))
                    each = np.repeat(times, spans)
                    for n in range(1, LONGEST_GRAM):
                        grams[name] += np.bincount(found[n], each, BUCKETS + 1).astype(np.int64)
                    letters[name] += np.bincount(scripts(first), times * (spans - 2), len(SCRIPT_NAMES)).astype(np.int64)
        for name in languages:
            used = np.flatnonzero(grams[name][:BUCKETS])
            used_scripts = np.flatnonzero(letters[name])
            bucket = np.concatenate([used, BUCKETS + used_scripts])
            n = np.concatenate([grams[name][used], letters[name][used_scripts]])
            columns = [pa.array([name] * len(bucket), pa.string()), pa.array(bucket, pa.int64()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])

    counted = known.where(drawn).mapInArrow(count, "lang string, bucket long, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    column = np.array([languages.index(x) for x in table.column("lang").to_pylist()], np.int64)
    counts = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(languages)))
    counts[table.column("bucket").to_numpy(), column] = table.column("n").to_numpy()
    grams, letters = counts[:BUCKETS], counts[BUCKETS:]
    smooth = 0.05
    logs = np.log((grams + smooth) / (grams.sum(axis=0) + smooth * BUCKETS))
    scores = np.zeros((BUCKETS + 1, len(languages)), np.float32)
    scores[:BUCKETS] = logs - logs.max(axis=1, keepdims=True)
    # A script belongs to a language that writes a hundredth of its letters in it.
    uses = letters >= np.maximum(1, 0.01 * letters.sum(axis=0))
    return Model(languages, scores, uses)


class Labeller:
    """Labels the words of texts with a model."""

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, np.float32(penalty)
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)), np.float32)
        self.letters = np.zeros(0, np.int64)

    def _learn(self, words: set[str]) -> None:
        missing = list(words.difference(self.known))
        if len(self.known) + len(missing) > REMEMBERED:
            missing, self.known = list(words), {}
            self.scores, self.letters = self.scores[:0], self.letters[:0]
        for start in range(0, len(missing), BATCH_WORDS):
            part = missing[start : start + BATCH_WORDS]
            found, starts, first = gram_buckets(part)
            total = sum(self.model.scores[found[n]] for n in range(1, LONGEST_GRAM))
            scores = np.add.reduceat(total, starts, axis=0)
            uses = self.model.uses[scripts(first)]
            scores = np.where(uses | ~uses.any(axis=1, keepdims=True), scores, np.float32(-1e6))
            letters = [len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in part]
            self.known.update(zip(part, range(len(self.scores), len(self.scores) + len(part)), strict=True))
            self.scores = np.concatenate([self.scores, scores.astype(np.float32)])
            self.letters = np.concatenate([self.letters, letters])

    def label(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the words of all texts one after the other: label and letters; and the words per text."""
        self._learn(set().union(*texts))
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        rows = np.fromiter((self.known[w] for words in texts for w in words), np.int64, counts.sum())
        return self.viterbi(self.scores[rows], counts), self.letters[rows], counts

    def viterbi(self, scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The best labels of each text's words; one step for the i-th words of all texts together."""
        starts = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        first, many = starts[order], counts[order]
        came = np.zeros(scores.shape, np.int8 if scores.shape[1] < 128 else np.int32)
        labels = np.zeros(len(scores), np.int64)
        active = int(np.count_nonzero(many))
        if not active:
            return labels
        best = scores[first[:active]]
        final = np.zeros(len(order), np.int64)
        stay = np.arange(scores.shape[1])
        for i in range(1, int(many[0])):
            going = int(np.searchsorted(-many, -i, side="left"))
            if going < active:
                final[going:active] = best[going:].argmax(axis=1)
                best, active = best[:going], going
            top = best.argmax(axis=1)
            jump = best[np.arange(active), top][:, None] - self.penalty
            switch = best < jump
            at = first[:active] + i
            came[at] = np.where(switch, top[:, None], stay)
            best = np.where(switch, jump, best) + scores[at]
        final[:active] = best.argmax(axis=1)
        now = final
        labels[first[many > 0] + many[many > 0] - 1] = now[many > 0]
        for i in range(int(many[0]) - 1, 0, -1):
            going = int(np.searchsorted(-many, -i, side="left"))
            at = first[:going] + i
            now[:going] = came[at, now[:going]]
            labels[at - 1] = now[:going]
        return labels


def identify(
    df: DataFrame, model: Model, text: str = "text", penalty: float = 8.0, spans: bool = False,
    out: tuple[str, str, str] = ("lang_pred", "score", "spans"),
) -> DataFrame:
    """Add lang_pred and score, and with `spans` the spans of one language, under the names in `out`.

    lang_pred is the language with most letters, ties go to the first by name; score is its share of the
    letters, from 0 to 1. A null text and a text without letters get `und` and 0, as does
    any text if the model knows no language. `spans` is an array of (start, end, lang) in code points, end
    exclusive, without the gaps before and after words. Columns of these names are replaced.
    """
    names = [f.name for f in df.schema.fields if f.name not in out[: 2 + spans]]
    languages = np.array([*model.languages, UNKNOWN], dtype=object)

    def predict(texts: list[str], labeller: Labeller) -> tuple[list, list, list]:
        lowered = [t.lower() for t in texts]
        words = [WORD.findall(t) for t in lowered]
        labels, letters, counts = labeller.label(words)
        size = len(model.languages)
        of = np.repeat(np.arange(len(texts)), counts)
        weight = np.bincount(of * size + labels, letters, len(texts) * size).reshape(len(texts), size)
        total = weight.sum(axis=1)
        top = weight.argmax(axis=1)
        score = np.divide(weight[np.arange(len(texts)), top], total, out=np.zeros(len(texts)), where=total > 0)
        found = languages[np.where(total > 0, top, size)].tolist()
        marked: list = [None] * len(texts)
        if spans:
            starts = np.cumsum(counts) - counts
            for i, text in enumerate(texts):
                own: list[dict] = []
                # Lower case can change the length of a text; the words are then found as they stand.
                same = len(text) == len(lowered[i])
                places = list(WORD.finditer(lowered[i] if same else text))
                if len(places) != counts[i]:
                    places = []
                for m, label in zip(places, labels[starts[i] : starts[i] + len(places)], strict=True):
                    if own and own[-1]["lang"] == languages[label]:
                        own[-1]["end"] = m.end()
                    else:
                        own.append({"start": m.start(), "end": m.end(), "lang": languages[label]})
                marked[i] = own
        return found, score.tolist(), marked

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model, penalty)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for start, end in row_groups(map(len, texts), BATCH_CHARS):
                if model.languages:
                    found, score, marked = predict(texts[start:end], labeller)
                else:
                    found, score, marked = [UNKNOWN] * (end - start), [0.0] * (end - start), [[]] * (end - start)
                columns = [c.slice(start, end - start) for c in batch.columns[:-1]]
                columns += [pa.array(found, pa.string()), pa.array(score, pa.float64())]
                if spans:
                    columns.append(pa.array(marked, kind))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *out[: 2 + spans]])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names]
    kinds = ["string", "double", "array<struct<start:long,end:long,lang:string>>"]
    fields += [f"`{name}` {kind}" for name, kind in zip(out[: 2 + spans], kinds, strict=False)]
    return df.select(*[f"`{n}`" for n in names], text_or_empty(text).alias("text read")).mapInArrow(label, ", ".join(fields))
