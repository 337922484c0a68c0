"""Text measures and regex positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIT_TYPE = "array<struct<column:int,value:string>>"


def shannon_entropy(value: Column) -> Column:
    """Bits per character; 0 for the empty string, null for null."""
    length = F.length(value).cast("double")

    def term(char: Column) -> Column:
        share = (length - F.length(F.replace(value, char, F.lit("")))) / length
        return share * F.log2(share)

    terms = F.transform(F.array_distinct(F.split(value, "")), term)
    total = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc - t)
    return F.when(length > 0, total).when(length == 0, F.lit(0.0))


def sql_string(text: str) -> str:
    """A text as a Spark SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Hits whose places are summed up one after the other; the sums of such pieces are summed up in turn.
PIECE = 256


def located_matches(column: str, regex: str) -> Column:
    """All matches of a regex in a column with their 1-based position, in order.

    ``split`` with a limit of -1 returns the text between the very matches that
    ``regexp_extract_all`` returns, so summing the lengths of both gives exact
    positions for any pattern, look-around and word boundaries included.
    """
    return F.expr(located_matches_sql(column, sql_string(regex)))


def located_matches_sql(column: str, pattern: str) -> str:
    """``located_matches`` as SQL, for a pattern that is an expression.

    Appending to an array copies it, so positions are summed within pieces of bounded length and then
    over the pieces. A one-element array names a value that is used more than once.
    """
    return f"""
        flatten(transform(array(regexp_extract_all({column}, {pattern}, 0)), vals ->
          transform(array(zip_with(slice(split({column}, {pattern}, -1), 1, size(vals)), vals,
            (gap, value) -> struct(length(gap) as gap, value))), steps ->
          transform(array(transform(sequence(0, greatest(size(steps) - 1, 0) div {PIECE}), piece ->
            aggregate(slice(steps, cast(piece * {PIECE} + 1 as int), {PIECE}),
              struct(0 as next, cast(array() as {HIT_TYPE}) as hits),
              (found, step) -> struct(
                found.next + step.gap + length(step.value) as next,
                array_append(found.hits, struct(found.next + step.gap as column, step.value as value)) as hits)))), pieces ->
          flatten(zip_with(pieces,
            aggregate(pieces, struct(1 as next, cast(array() as array<int>) as starts),
              (found, piece) -> struct(found.next + piece.next as next, array_append(found.starts, found.next) as starts),
              found -> found.starts),
            (piece, start) -> transform(piece.hits, hit -> struct(hit.column + start as column, hit.value as value)))))[0])[0]))
    """


def number_text(value: Column) -> Column:
    """A number as scripts print it: all its digits, no trailing ``.0``, an exponent from 1e21 on and below 1e-6."""
    text = value.cast("double").cast("string")
    size = F.abs(value.cast("double"))
    wide = F.when(size < 1, text.try_cast("decimal(38,30)").cast("string")).otherwise(
        text.try_cast("decimal(38,16)").cast("string")
    )
    plain = F.regexp_replace(F.regexp_replace(wide, "0+$", ""), r"\.$", "")
    mantissa = F.regexp_replace(F.regexp_extract(text, "^(.*)E", 1), r"\.0$", "")
    exponent = F.regexp_replace(F.regexp_extract(text, "E(.*)$", 1), "^([0-9])", "+$1")
    return (
        F.when(~text.contains("E"), F.regexp_replace(text, r"\.0$", ""))
        .when((size >= 1e-6) & (size < 1e21), plain)
        .otherwise(F.concat(mantissa, F.lit("e"), exponent))
    )


def glob_regex(glob: str) -> str:
    """A path glob as an anchored regex: ``**/`` any folders, ``*`` one name part."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            char = glob[i]
            out, i = out + (char if char.isalnum() or char in "/_-" else "\\" + char), i + 1
    return f"^{out}$"


def matches_any_glob(path: Column, globs: list[str]) -> Column:
    """True where a path matches at least one of the globs."""
    if not globs:
        return F.lit(False)
    return path.rlike("|".join(glob_regex(g) for g in globs))


def label_map(mapping: dict, key: Column) -> Column:
    """Look a key up in a short fixed mapping; null when absent."""
    pairs = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def explode_once(array: Column) -> Column:
    """``explode`` for an array that is costly to make.

    For a plain ``explode`` Spark first filters on the size of the array, which
    makes the array twice and may move that work in front of cheaper filters.
    The outer form is left alone; drop its null rows afterwards.
    """
    return F.explode_outer(array)
