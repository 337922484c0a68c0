"""Token counts and ids of whole texts, encoded piece by piece.

A text is split at safe boundaries: before a space that follows a character
other than white space. No token of the tokenizers used here reaches over such a
place, as their patterns allow a space only at the start of a token or drop it. Pieces
that are plain words are split once more, between letters and a full stop or the like and around a
single line end. Words of letters, which the tokenizers never split before they merge, go to the tokenizer's
model alone, other pieces through the whole tokenizer; bounded tables of short pieces serve the
repeats. Texts come in Arrow batches that are balanced by bytes, and only lengths or id bytes leave the encoder.

Null and empty texts have no tokens. Strings of special tokens inside a text are
read as the tokenizer does by default; no special tokens are added.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# Pieces a Python worker remembers, and the longest of them.
REMEMBERED = 500_000
SHORT = 48

_UNSAFE = re.compile(r"\s ")
_SAFE = re.compile(r"(?<=\S) ")
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_WORD = re.compile(f" ?{_LETTERS}")
_PLAIN = re.compile(rf" {_LETTERS}[.,;:!?]?(?:\n{_LETTERS}[.,;:!?]?)*")
_PARTS = re.compile(rf" ?{_LETTERS}|[.,;:!?\n]")


class Remembered(dict):
    """What is kept of pieces; encodes the missing ones and remembers the short ones."""

    def __init__(self, encode: Callable):
        self.encode = encode

    def __missing__(self, piece: str):
        kept = self.encode(piece)
        if len(piece) <= SHORT:
            self[piece] = kept
        return kept


class PieceEncoder:
    """Encodes texts with one tokenizer file; `read` and `join` tell what is kept of a part and of several.

    It remembers `remembered` pieces and `parts` parts of pieces, some 200 bytes each; more of them cost memory and save time.
    """

    def __init__(self, path: str, read: Callable, join: Callable, remembered: int = REMEMBERED, parts: int = REMEMBERED // 5):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.read, self.join = read, join
        self.most, self.most_parts = remembered, parts
        # Of pieces behind the first one of a text, without the space in front; and of parts as they stand.
        self.known = Remembered(self._piece)
        self.parts = Remembered(self._part)
        # How the tokenizer hands letters, and the space in front of them, to its model.
        letters = [chr(c) for c in range(0x100) if re.fullmatch(_LETTERS, chr(c))]
        space = self._handed(" a").removesuffix(self._handed("a"))
        self.table = {ord(c): self._handed(c) for c in letters} | {ord(" "): space}
        self.space, self.lowers = space, self._handed("A") == "a"

    def _handed(self, text: str) -> str:
        if self.tokenizer.normalizer:
            text = self.tokenizer.normalizer.normalize_str(text)
        return "".join(own for own, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))

    def _word(self, handed: str):
        return self.read([t.id for t in self.model.tokenize(handed)])

    def _piece(self, piece: str):
        if piece.isascii() and piece.isalpha():
            return self._word(self.space + (piece.lower() if self.lowers else piece))
        text = " " + piece
        if _PLAIN.fullmatch(text):
            return self.join([self.parts[part] for part in _PARTS.findall(text)])
        return self._part(text)

    def _part(self, text: str):
        if _WORD.fullmatch(text):
            return self._word(text.translate(self.table))
        return self.read(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text; the space in front of each but the first is left out."""
        return _SAFE.split(text) if _UNSAFE.search(text) else text.split(" ")

    def encode(self, texts: list[str]) -> Iterator[list]:
        """For each text what is kept of its pieces, in order."""
        for text in texts:
            for table, most in ((self.known, self.most), (self.parts, self.most_parts)):
                if len(table) > most:
                    table.clear()
            head, *rest = self.pieces(text)
            yield [self.parts[head], *map(self.known.__getitem__, rest)]


def id_bytes(ids: list[int]) -> bytes:
    """The ids as little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


@functools.lru_cache(maxsize=4)
def counter(path: str) -> PieceEncoder:
    return PieceEncoder(path, len, sum)


@functools.lru_cache(maxsize=4)
def encoder(path: str, remembered: int = REMEMBERED, parts: int = REMEMBERED // 5) -> PieceEncoder:
    return PieceEncoder(path, id_bytes, b"".join, remembered, parts)


def text_ids(path: str, texts: list[str], *remembered: int) -> Iterator[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers; see PieceEncoder for what is remembered."""
    for kept in encoder(path, *remembered).encode(texts):
        yield b"".join(kept)


def token_counts(df: DataFrame, tokenizer: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of each whole text.

    `tokenizer` is the path of a tokenizer file every executor has. A column
    that is already named `out` is replaced; rows, order and other columns stay.
    Arrow batches are bounded by bytes (spark.sql.execution.arrow.maxBytesPerBatch).
    """

    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([sum(kept) for kept in counter(tokenizer).encode(batch.tolist())], dtype="int64")

    count = F.pandas_udf(lengths, "long")
    return df.withColumn(out, count(text_or_empty(text)))
