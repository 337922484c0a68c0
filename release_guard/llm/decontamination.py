"""Benchmark decontamination by templates.

Texts become templates: numbers, quantities with a unit and names turn into typed
placeholders, all other words into lower case without punctuation. Windows of template
words of the benchmark items and of the documents are joined by hash. The values that
stood at the placeholders, the slots, must then map consistently within one occurrence: one value of the item
always to one value of the document. So a question asked again with other numbers or names is found, while
chance hits of a template are not.

A second reading of every text without names catches copies with other capitals, a third takes capitalised words
at the start of a sentence for names too. Items that give no template window, such as plain
arithmetic, are joined by literal windows of all words with their values. Characters of scripts that write no
spaces are words of their own. A bitmap
of fixed size, made from the benchmark's windows, lets a task drop nearly all windows of a
document before the join, whatever the size of the benchmark.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import row_groups, text_key, text_or_empty
from .jaccard import MIX, mixed

BITMAP_BITS = 22
# Distinct words a task remembers, some 300 bytes each.
REMEMBERED = 150_000
# Characters of text read together.
GROUP_CHARS = 2 << 20
PUNCTUATION = string.punctuation.replace("%", "").replace("$", "") + "«»„“”‘’…–—·¿¡¡，。？！、；：（）「」『』《》〈〉【】〔〕・　"
# Words that make a number a quantity.
UNITS = frozenset(
    "% percent mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms "
    "lb lbs pound pounds oz ounce ounces t ton tons tonne tonnes ml cl l liter liters litre litres gallon gallons ms s sec "
    "second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw mw "
    "kwh v volt volts a amp amps j joule joules cal kcal k c f degree degrees kb mb gb tb bit bits byte bytes $ usd eur "
    "gbp dollar dollars cent cents euro euros mph kmh people persons times".split()
)
QUANTITY = re.compile(r"[+-]?([$€£]?)(\d[\d.,:/]*)([A-Za-z%]*)")
# Thai, Lao, Burmese, Khmer, kana and Chinese characters; their punctuation also parts words.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3000-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff！（），：；？\U00020000-\U0003ffff]")
# Words of these alone count in literal windows.
SIGNS = frozenset("+-*/=<>^×÷−±≤≥≠")
READINGS = range(4)
NAMES, NO_NAMES, ALL_NAMES, LITERAL = READINGS
WORD, NUM, UNIT, QTY, CAPITAL, NOTHING = range(6)
EMPTY = np.uint64(xxhash.xxh3_64_intdigest(""))
CODES = {NUM: 0x1B873593CC9E2D51, QTY: 0x52DCE729DA3ED7A1, CAPITAL: 0x38B34AE5A1E38B93}


def split_words(text: str) -> list[str]:
    if not text.isascii() and UNSPACED.search(text):
        text = UNSPACED.sub(r" \g<0> ", text)
    return text.split()


class Numbers(dict):
    """Numbers words in the order they are met; `read` is called with each new one."""

    def __init__(self, read: Callable[[str], None]):
        self.read = read

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.read(word)
        return number


class TemplateWords:
    """What is known of each distinct word: its kind, its code, its plain form, whether it ends a sentence."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.known = Numbers(self._meet)
        self.plain: list[str] = []
        self.new: tuple[list[int], list[int], list[bool]] = ([], [], [])
        self.kinds, self.codes, self.ends = np.zeros(0, np.int8), np.zeros(0, np.uint64), np.zeros(0, bool)

    def _read(self, word: str) -> tuple[int, str, bool]:
        if word.isalpha() and word.islower():
            return (UNIT if word in UNITS else WORD), word, False
        bare = word.strip(PUNCTUATION)
        low = bare.lower()
        kind = WORD
        if not bare:
            kind = NOTHING
            low = word if SIGNS.issuperset(word) else ""
        elif bare[0].isdigit() or bare[0] in "$€£+-":
            found = QUANTITY.fullmatch(bare)
            if found:
                kind = QTY if found[1] or found[3] and found[3].lower() in UNITS else NUM if not found[3] else WORD
        if kind == WORD and low in UNITS:
            kind = UNIT
        elif kind == WORD and len(bare) > 1 and bare[0].isupper() and bare[1:].islower():
            kind = CAPITAL
        return kind, low, word.rstrip("\"')]}»”’").endswith((".", "!", "?", ":", "。", "！", "？", "："))

    def _meet(self, word: str) -> None:
        kind, low, end = self._read(word)
        self.plain.append(low)
        kinds, codes, ends = self.new
        kinds.append(kind)
        codes.append(xxhash.xxh3_64_intdigest(low))
        ends.append(end)

    def ids(self, words: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.forget()
        found = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        kinds, codes, ends = self.new
        self.kinds = np.concatenate([self.kinds, np.array(kinds, np.int8)])
        self.codes = np.concatenate([self.codes, np.array(codes, np.uint64)])
        self.ends = np.concatenate([self.ends, np.array(ends, bool)])
        self.new = ([], [], [])
        return found


class Reading:
    """The template words of several texts one after the other: their codes, texts, and which are slots."""

    def __init__(self, ids: np.ndarray, of: np.ndarray, words: TemplateWords, reading: int):
        self.ids, self.words, self.literal = ids, words, reading == LITERAL
        if self.literal:
            self.more = np.zeros(len(ids), bool)
            self.at = np.flatnonzero(words.codes[ids] != EMPTY)
            self.of, self.codes = of[self.at], words.codes[ids[self.at]]
            self.slot = np.zeros(len(self.at), bool)
            return
        kind = words.kinds[ids]
        same = np.zeros(len(ids), bool)
        same[1:] = of[1:] == of[:-1]
        unit = np.zeros(len(ids), bool)
        unit[1:] = same[1:] & (kind[1:] == UNIT) & (kind[:-1] == NUM)
        kind[np.flatnonzero(unit) - 1] = QTY
        inside = same.copy()
        inside[1:] &= ~words.ends[ids[:-1]]
        name = (kind == CAPITAL) & (inside | (reading == ALL_NAMES)) & (reading != NO_NAMES)
        again = np.zeros(len(ids), bool)
        again[1:] = name[1:] & name[:-1] & inside[1:]
        kind[(kind == CAPITAL) & ~name] = WORD
        self.more = unit | again
        self.at = np.flatnonzero((kind != NOTHING) & ~self.more)
        kind = kind[self.at]
        self.of = of[self.at]
        self.slot = np.isin(kind, (NUM, QTY, CAPITAL))
        self.codes = words.codes[ids[self.at]]
        for k, code in CODES.items():
            self.codes[kind == k] = code

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows, and which lie in one text and, but for literal ones, have enough plain words."""
        n = max(0, len(self.codes) - width + 1)
        total = np.full(n, width, np.uint64)
        for i in range(width):
            total = total * MIX[0] + self.codes[i : n + i]
        total = mixed(total)
        good = self.of[:n] == self.of[width - 1 :][:n]
        if not self.literal:
            plain = np.concatenate([[0], np.cumsum(~self.slot)])
            good &= 2 * (plain[width:][:n] - plain[:n]) >= width
        return total, good

    def values(self, place: int, width: int) -> list[str]:
        """What stands at the slots of a window."""
        found = []
        for i in np.flatnonzero(self.slot[place : place + width]) + place:
            first = last = int(self.at[i])
            while last + 1 < len(self.more) and self.more[last + 1]:
                last += 1
            found.append(" ".join(self.words.plain[j] for j in self.ids[first : last + 1]))
        return found


FIELDS = [
    ("id", pa.int64()), ("text_key", pa.int64()), ("reading", pa.int32()), ("hash", pa.int64()), ("place", pa.int64()),
    ("windows", pa.int64()), ("width", pa.int32()), ("slots", pa.list_(pa.string())),
]
DDL = "id long, text_key long, reading int, hash long, place long, windows long, width int, slots array<string>"


def template_windows(df: DataFrame, width: int, widths: dict[int, list[int]] | None = None, bitmap: bytes | None = None) -> DataFrame:
    """The template windows of id, text_key and text: hash, place, windows of the text, and values at its slots.

    Without `widths`, those wanted in each reading, a text shorter than `width` is one window of its own length, and only
    texts without any template window have literal ones. With a bitmap only windows whose bit is set are
    returned. At least half of a template window's words must be plain. Windows of less than 3 words are literal and a whole text.
    """
    schema = pa.schema(FIELDS)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = TemplateWords()
        wanted = None if bitmap is None else np.unpackbits(np.frombuffer(bitmap, np.uint8)).astype(bool)
        for batch in batches:
            docs, keys, texts = (column.to_pylist() for column in batch.columns)
            for start, end in row_groups(map(len, texts), GROUP_CHARS):
                split = [split_words(text) for text in texts[start:end]]
                counts = np.fromiter(map(len, split), np.int64, len(split))
                ids = words.ids([w for own in split for w in own])
                of = np.repeat(np.arange(start, end), counts)
                rows = []
                matched: set[int] = set()
                for reading in READINGS if widths is None else sorted(widths):
                    found = Reading(ids, of, words, reading)
                    first = np.searchsorted(found.of, np.arange(start, end))
                    size = np.diff(np.append(first, len(found.of)))
                    own = np.minimum(size, width)
                    for w in sorted(set(own.tolist())) if widths is None else widths[reading]:
                        if w < (1 if found.literal else 3):
                            continue
                        hashes, good = found.windows(w)
                        n = np.bincount(found.of[: len(good)][good], minlength=end)
                        if wanted is not None:
                            good &= wanted[hashes >> np.uint64(64 - BITMAP_BITS)]
                        for at in np.flatnonzero(good).tolist():
                            doc = int(found.of[at])
                            if widths is None and (own[doc - start] != w or found.literal and doc in matched):
                                continue
                            if w < 3 and size[doc - start] != w:
                                continue
                            if not found.literal:
                                matched.add(doc)
                            place, value = at - int(first[doc - start]), int(hashes[at].astype(np.int64))
                            rows.append((docs[doc], keys[doc], reading, value, place, int(n[doc]), w, found.values(at, w)))
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return df.select("id", "text_key", "text").mapInArrow(windows, DDL)


def _covered(hits: DataFrame, pair: list[str], least_cover: float) -> DataFrame:
    """The hits of the pairs whose hits cover enough of the item, wherever they lie: no other pair has an occurrence."""
    share = F.size(F.collect_set("item_place")) / F.max("item_windows")
    enough = hits.groupBy(*pair).agg(share.alias("share")).where(F.col("share") >= least_cover)
    enough = enough.select(*[F.col(c).alias(f"enough {c}") for c in pair])
    same = [F.col(c).eqNullSafe(F.col(f"enough {c}")) for c in pair]
    return hits.join(enough, same, "left_semi")


def occurrences(hits: DataFrame, pair: list[str]) -> DataFrame:
    """The hits of each possible occurrence of an item in a document, which scope and number name.

    Scope 0 is one alignment: all hits of one distance between document place and item place. Scope 1 is a band of
    distances as wide as the item, for copies with words more or less; bands overlap by half, and each place of
    the item takes the hit nearest to the distance with most hits, so repeated templates do not match
    crosswise. Scope 2 is the whole document, for items whose parts lie far from each other.
    """
    rows = hits.withColumn("distance", F.col("place") - F.col("item_place"))
    columns = [*pair, "scope", "number", "item_place", "item_windows", "item_slots", "slots"]
    aligned = rows.withColumns({"scope": F.lit(0), "number": F.col("distance")})
    half = F.ceil(F.col("item_windows") / 2)
    band = F.floor(F.col("distance") / half)
    bands = rows.withColumns({"scope": F.lit(1), "number": F.explode(F.array(band - 1, band))})
    own = [*pair, "number"]
    bands = bands.withColumn("n", F.count("*").over(Window.partitionBy(*own, "distance")))
    middle = F.max_by("distance", F.struct("n", -F.col("distance"))).over(Window.partitionBy(*own))
    bands = bands.withColumn("middle", middle)
    off = F.struct(F.abs(F.col("distance") - F.col("middle")), "distance")
    nearest = F.min_by(F.struct("item_windows", "item_slots", "slots"), off).alias("nearest")
    bands = bands.groupBy(*own, "scope", "item_place").agg(nearest).select(*own, "scope", "item_place", "nearest.*")
    whole = rows.withColumns({"scope": F.lit(2), "number": F.lit(0).cast("long")})
    return aligned.select(columns).unionByName(bands.select(columns)).unionByName(whole.select(columns))


def contaminated(
    documents: DataFrame, benchmark: DataFrame, width: int = 8, least_cover: float = 0.5, least_consistency: float = 0.8,
    id_column: str = "doc_id", item_column: str = "item_id", text: str = "text",
) -> DataFrame:
    """Pairs of a document and a benchmark item it contains: doc_id, text_key, item_id, n_windows, cover, n_slots,
    consistency, changed.

    `cover` is the share of the item's windows found in one occurrence, `consistency` the share of the item's different
    slot values that stand for one value of the document there (1 without slots), `changed` tells whether any slot has another
    value. The best of the `occurrences` of a pair is given. Items of fewer than `width` template words are one window. Items without a template
    window match literally, those of one or two words only texts that are nothing else, as they occur everywhere by chance.
    Null and empty texts and those of punctuation alone match nothing. Rows of a repeated id with different texts are judged each for itself;
    repeated rows give one. Items without an id take no part.
    """
    docs = documents.select(F.col(id_column).cast("long").alias("id"), text_key(text).alias("text_key"), text_or_empty(text).alias("text"))
    items = benchmark.select(F.col(item_column).cast("long").alias("id"), text_key(text).alias("text_key"), text_or_empty(text).alias("text"))
    own = stored(template_windows(items.where("id is not null"), width), "benchmark-windows")
    widths: dict[int, list[int]] = {}
    for r in own.select("reading", "width").distinct().collect():
        widths.setdefault(r["reading"], []).append(r["width"])
    # At most 2**BITMAP_BITS numbers.
    prefix = F.shiftrightunsigned(F.col("hash"), 64 - BITMAP_BITS).cast("int").alias("bit")
    set_bits = own.select(prefix).distinct().toArrow().column("bit").to_numpy()
    bits = np.zeros(1 << BITMAP_BITS, bool)
    bits[set_bits] = True
    found = template_windows(docs, width, widths, np.packbits(bits).tobytes()) if widths else own.limit(0)

    named = own.select(
        F.col("id").alias("item_id"), F.col("text_key").alias("item_key"), "reading", "hash", "width",
        F.col("place").alias("item_place"), F.col("windows").alias("item_windows"), F.col("slots").alias("item_slots"),
    ).dropDuplicates(["item_id", "item_key", "reading", "item_place"])
    hits = found.drop("windows").join(named, ["reading", "hash", "width"])
    pair = ["id", "text_key", "item_id", "item_key", "reading"]
    # Repeated rows of a document give the same hits.
    places = ["item_place", "item_windows", "item_slots", "place", "slots"]
    hits = stored(hits.select(*pair, *places).dropDuplicates([*pair, "item_place", "place"]), "template-hits")
    cells = occurrences(_covered(hits, pair, least_cover), pair)
    scope = [*pair, "scope", "number"]
    # A slot of the item and what stands in its place; windows without slots give one row.
    slots = F.explode_outer(F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("doc")))
    rows = cells.select(*scope, "item_place", "item_windows", slots.alias("slot"))
    values = rows.groupBy(*scope, "slot.item").agg(
        F.min("slot.doc").alias("low"), F.max("slot.doc").alias("high"),
        F.collect_set("item_place").alias("places"), F.max("item_windows").alias("item_windows"),
    )
    present = F.col("item").isNotNull()
    judged = values.groupBy(*scope).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n_windows"),
        F.max("item_windows").alias("item_windows"),
        F.count_if(present).alias("n_slots"),
        F.count_if(present & (F.col("low") == F.col("high"))).alias("n_steady"),
        F.bool_or(F.coalesce(present & ((F.col("low") != F.col("item")) | (F.col("high") != F.col("item"))), F.lit(False))).alias("changed"),
    )
    cover = F.col("n_windows") / F.col("item_windows")
    steady = F.when(F.col("n_slots") == 0, 1.0).otherwise(F.col("n_steady") / F.col("n_slots"))
    good = judged.select(
        F.col("id").alias("doc_id"), "text_key", "item_id", "reading", "scope", F.col("n_windows").cast("long").alias("n_windows"),
        cover.alias("cover"), F.col("n_slots").cast("long").alias("n_slots"), steady.alias("consistency"), "changed",
    ).where((F.col("cover") >= least_cover) & (F.col("consistency") >= least_consistency))
    order = F.struct("cover", "consistency", ~F.col("changed"), -F.col("reading"), -F.col("scope"), "n_slots")
    best = F.max_by(F.struct("n_windows", "cover", "n_slots", "consistency", "changed"), order)
    return good.groupBy("doc_id", "text_key", "item_id").agg(best.alias("best")).select("doc_id", "text_key", "item_id", "best.*")
