"""All hits of many regexes in lines of any length, in Arrow batches.

A line is read once per regex and its hits are found in order, so time and memory grow with the line alone: no array
of hits is built per line, and a hit carries an excerpt of the line or, where asked, the line, in batches of a few MB. Only regexes
whose syntax all engines read alike come here (``portable``); hits of others are located in the JVM and passed in.
"""

from __future__ import annotations

import math
import re
import warnings
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc

from .. import rules
from ..rules import SecretPattern
from .prefilter import VERTICAL_TAB, _either, portable

# Bytes of output that are handed on at once.
FLUSH_BYTES = 4 << 20
HIT_FIELDS = [
    ("column", pa.int32()), ("value", pa.string()), ("pattern_name", pa.string()), ("severity", pa.string()),
    ("pattern_entropy", pa.float64()), ("entropy", pa.float64()), ("context", pa.string()),
]
HIT_SCHEMA = (
    "column int, value string, pattern_name string, severity string, pattern_entropy double, entropy double, context string"
)
HIT_NAMES = [name for name, _ in HIT_FIELDS]

# A dot outside a class, an escaped character or a class as one piece.
_PIECE = re.compile(r"\\.|\[(?:\\.|[^\]\\])+\]|\.", re.S)
_NOT_LINE_END = "[^\\n\\r\\u0085\\u2028\\u2029]"


def compiled(regex: str) -> re.Pattern[str]:
    """A portable regex with the meaning it has in the JVM: ASCII classes, and a dot that stops at any line end."""
    flags = re.ASCII
    if regex.startswith("(?i)"):
        regex, flags = regex[4:], flags | re.IGNORECASE
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", FutureWarning)
        return re.compile(_PIECE.sub(lambda m: _NOT_LINE_END if m[0] == "." else m[0], regex), flags)


def entropy_of(value: str) -> float:
    """Bits per character to six digits; 0 for the empty text."""
    size = len(value)
    total = 0.0
    for n in Counter(value).values():
        total -= n / size * math.log2(n / size)
    return round(total, 6) + 0.0


@dataclass
class Matcher:
    """The patterns of one scan; ``tokens`` also looks for long tokens that no named hit overlaps.

    Hits below their own limit, or else ``threshold``, are left out if a threshold is given. ``whole_lines`` gives the
    line itself as the context of a hit.
    """

    patterns: tuple[SecretPattern, ...]
    named: bool = True
    tokens: bool = False
    threshold: float | None = None
    whole_lines: bool = False
    regexes: list[re.Pattern[str] | None] = field(init=False)
    # Per pattern the first one of the same regex, which alone is searched for, and those that have followers.
    first: list[int] = field(init=False)
    shared: set[int] = field(init=False)
    gate: str | None = field(init=False)

    def __post_init__(self) -> None:
        place = {regex: no for no, regex in reversed(list(enumerate(p.regex for p in self.patterns)))}
        known = {regex: compiled(regex) if portable(regex) else None for regex in place}
        self.regexes = [known[p.regex] for p in self.patterns]
        self.first = [place[p.regex] for p in self.patterns]
        self.shared = {first for no, first in enumerate(self.first) if first != no}
        wanted = [p.regex for p, r in zip(self.patterns, self.regexes, strict=True) if r is not None and self.named]
        wanted += [rules.TOKEN_REGEX] if self.tokens else []
        self.gate = _either(list(dict.fromkeys(wanted))) if wanted else None
        self.token = compiled(rules.TOKEN_REGEX)
        self.token_pattern = SecretPattern(rules.TOKEN_PATTERN_NAME, rules.TOKEN_REGEX, rules.TOKEN_SEVERITY)

    def suspects(self, texts: pa.Array) -> pa.Array:
        """True wherever a regex of this matcher matches; possibly also elsewhere."""
        if self.gate is None:
            return pa.array([False] * len(texts))
        odd = pc.match_substring(texts, VERTICAL_TAB)
        return pc.fill_null(pc.or_(odd, pc.match_substring_regex(texts, self.gate)), False)

    def hits(self, text: str, located: Sequence[dict[str, Any]] = ()) -> Iterator[tuple]:
        """Hits of the named patterns in their order, then the tokens; ``located`` has those found elsewhere.

        ``located`` gives ``no``, the number of the pattern, ``column`` and ``value``.
        """
        spans: list[tuple[int, int]] = []
        elsewhere: dict[int, list[tuple[int, str]]] = {}
        for hit in located or ():
            elsewhere.setdefault(hit["no"], []).append((hit["column"] - 1, hit["value"]))
        kept: dict[int, list[tuple[int, str, float]]] = {}
        for no, (pattern, regex, first) in enumerate(zip(self.patterns, self.regexes, self.first, strict=True)):
            if first == no:
                found = elsewhere.get(no, []) if regex is None else ((m.start(), m[0]) for m in regex.finditer(text))
                found = ((start, value, entropy_of(value)) for start, value in found)
                if no in self.shared:
                    found = kept[no] = list(found)
            else:
                found = kept[first]
            for start, value, entropy in found:
                if self.tokens and first == no:
                    spans.append((start, start + len(value)))
                if self.named:
                    yield from self._hit(text, start, value, pattern, entropy)
        if self.tokens:
            spans.sort()
            starts = [s for s, _ in spans]
            reach, furthest = [], 0
            for _, end in spans:
                furthest = max(furthest, end)
                reach.append(furthest)
            for m in self.token.finditer(text):
                before = bisect_left(starts, m.end())
                if not before or reach[before - 1] <= m.start():
                    yield from self._hit(text, m.start(), m[0], self.token_pattern, entropy_of(m[0]))

    def _hit(self, text: str, start: int, value: str, pattern: SecretPattern, entropy: float) -> Iterator[tuple]:
        limit = pattern.entropy if pattern.entropy is not None else self.threshold
        if self.threshold is None or entropy >= limit:
            context = text if self.whole_lines else text[max(0, start - rules.CONTEXT_BEFORE) : start + rules.CONTEXT_AFTER]
            yield start + 1, value, pattern.name, pattern.severity, pattern.entropy, entropy, context


def hit_batches(
    batches: Iterator[pa.RecordBatch], matcher_of: Any, rest: Sequence[str]
) -> Iterator[pa.RecordBatch]:
    """The hits of all lines of the batches, with the ``rest`` of the columns of their line.

    ``matcher_of(batch)`` gives pairs of a matcher and the rows it is for. The columns ``text`` and, optionally, ``located`` are read.
    """
    for batch in batches:
        texts = batch.column("text")
        located = batch.column("located") if "located" in batch.schema.names else None
        for matcher, rows in matcher_of(batch):
            own = texts if rows is None else texts.take(rows)
            wanted = matcher.suspects(own)
            if located is not None:
                given = located if rows is None else located.take(rows)
                wanted = pc.or_(wanted, pc.greater(pc.fill_null(pc.list_value_length(given), 0), 0))
            at = pc.indices_nonzero(wanted)
            at = at if rows is None else rows.take(at)
            source: list[int] = []
            found: list[tuple] = []
            size = 0
            for row in at.to_pylist():
                hits = () if located is None else located[row].as_py()
                for hit in matcher.hits(texts[row].as_py(), hits):
                    source.append(row)
                    found.append(hit)
                    size += len(hit[1]) + len(hit[-1]) + 64
                    if size >= FLUSH_BYTES:
                        yield _hit_batch(batch, rest, source, found)
                        source, found, size = [], [], 0
            if found:
                yield _hit_batch(batch, rest, source, found)


def _hit_batch(batch: pa.RecordBatch, rest: Sequence[str], source: list[int], found: list[tuple]) -> pa.RecordBatch:
    taken = batch.select(list(rest)).take(pa.array(source, pa.int64()))
    columns = [pa.array(values, kind) for values, (_, kind) in zip(zip(*found, strict=True), HIT_FIELDS, strict=True)]
    return pa.RecordBatch.from_arrays([*taken.columns, *columns], names=[*rest, *HIT_NAMES])
