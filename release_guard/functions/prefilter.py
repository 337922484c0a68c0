"""A fast first test of texts against many regexes.

Almost no line of a code base holds a secret, so nearly all time of a scan goes
into finding that out. The test runs Arrow's compiled regex kernel over whole
column batches, which is far faster than a regex per row in the JVM. It may let
too much through but never too little; the exact matches are taken by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The syntax both dialects read alike, so that Arrow's engine finds whatever Java's finds. All else, such as
# look-around, anchors, flags but a leading (?i), classes inside classes and possessive repetition, stays in the JVM.
_ESCAPE = r"\\[dDwWsSnrt.\-+*?()\[\]{}|/^$\"'=:@,;!#%&<>~_ ]"
_LITERAL = r"[A-Za-z0-9_ \"'<>=:;,@#%&~!/`-]"
_CLASS = rf"\[\^?(?:[A-Za-z0-9_ \"'<>=:;,@#%~!/`.+*?(){{}}|$-]|{_ESCAPE})+\]"
_ATOM = rf"(?:{_ESCAPE}|{_LITERAL}|{_CLASS}|\.)"
_REPEAT = r"(?:(?:[*+?]|\{\d{1,3}(?:,\d{0,3})?\})\??(?![*+?{]))?"
_PORTABLE = re.compile(rf"(?:\(\?i\))?(?:{_ATOM}{_REPEAT}|\((?:\?:)?(?!\?)|\){_REPEAT}|\|)*")
# Without regard to case Arrow's engine also folds letters outside ASCII, so a negated class may lose some.
_NEGATED_LETTERS = re.compile(r"\[\^[^\]]*?(?<!\\)[A-Za-z]|\[\^[^\]]*\\[wWD]")
VERTICAL_TAB = "\x0b"


def portable(regex: str) -> bool:
    """Whether both dialects read the regex alike and a match needs no context."""
    if not _PORTABLE.fullmatch(regex) or regex.startswith("(?i)") and _NEGATED_LETTERS.search(regex):
        return False
    try:
        pc.match_substring_regex(pa.array([""]), regex)
    except pa.ArrowInvalid:
        return False
    return True


def _batch_test(regex: str) -> Callable[[Column], Column]:
    @F.arrow_udf("boolean")
    def test(texts: pa.Array) -> pa.Array:
        # The dialects disagree on whether a vertical tab is white space.
        odd = pc.match_substring(texts, VERTICAL_TAB)
        return pc.or_(odd, pc.match_substring_regex(texts, regex))

    return test


def may_match(text: Column, regexes: Sequence[str]) -> Column:
    """True wherever a regex matches; possibly also elsewhere."""
    fast = [r for r in regexes if portable(r)]
    slow = [r for r in regexes if r not in fast]
    tests = []
    if fast:
        tests.append(_batch_test(_either(fast))(F.make_valid_utf8(text)))
    if slow:
        tests.append(text.rlike(_either(slow)))
    return tests[0] if len(tests) == 1 else tests[0] | tests[1]


def _either(regexes: Sequence[str]) -> str:
    return "|".join(f"(?:{r})" for r in regexes)
