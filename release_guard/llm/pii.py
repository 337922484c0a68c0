"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Everything here is made of DataFrame functions. A text is split at the matches of a pattern; matches and the gaps
between them are rows, whose running length gives the places. Only texts with a match take
part in a shuffle, and only with their matches and the few characters around them.

The patterns are written so that a search is linear: each may only start where a run of its first characters starts or
where the last match ended, as a later start in the run fails for the same reason.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_key, text_or_empty

# Characters of the text looked at before and after a match.
NEARBY = 48


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: its pattern, what every text with it contains, words that speak for it."""

    name: str
    pattern: str
    needs: str
    words: str
    prior: float


# The lengths of account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """A country's code with as many characters as it prescribes, so that words after a number do not join it.

    Codes of no known length take what follows, up to the start of a known one.
    """
    own = {length: "|".join(codes.split()) for length, codes in IBAN_LENGTHS.items()}
    exact = "|".join(rf"(?:{codes})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{length - 4}}}" for length, codes in own.items())
    known = rf"(?:{'|'.join(own.values())})[0-9]{{2}}"
    other = rf"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]|\x20(?!{known}(?:\x20?[A-Z0-9]){{11}})[A-Z0-9]){{11,30}}"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{exact}|{other})(?![A-Za-z0-9])"


# The base patterns in their order, then those this operator adds.
KINDS = [
    Kind(
        "email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
        r"(?i)\b(?:e-?mail|mail|contact|write|kontakt|correo|courriel)\b", 0.8,
    ),
    Kind(
        "ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", ".",
        r"(?i)\b(?:ip|address|host|server|login|client|adresse)\b", 0.6,
    ),
    Kind(
        "card", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++", "",
        r"(?i)\b(?:card|credit|visa|mastercard|amex|debit|karte|tarjeta|carte)\b", 0.7,
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+",
        r"(?i)\b(?:phone|tel|telephone|mobile|call|fax|telefon|telefono|appel)\b", 0.6,
    ),
    Kind(
        "iban", _iban_pattern(), "",
        r"(?i)\b(?:iban|account|bank|konto|cuenta|compte)\b", 0.9,
    ),
    # Numbers that are nothing by themselves: only a word nearby lifts them over the least score.
    Kind(
        "tel", r"(?<![0-9A-Za-z+.,/-])(?:\([0-9]{2,5}\)[\x20-]?|[0-9]{2,5}[\x20/-])[0-9]{3,4}[\x20-]?[0-9]{3,5}(?![0-9A-Za-z]|[.,/-][0-9])", "",
        r"(?i)\b(?:phone|tel|telephone|mobile|cell|call|fax|telefon|handy|telefono|teléfono|appel|téléphone)\b", 0.4,
    ),
    Kind(
        "taxid", r"(?<![0-9A-Za-z.,-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|[.,-][0-9])", "-",
        r"(?i)\b(?:ssn|social\x20security|tax|taxpayer|itin|steuer|steuernummer|seguridad\x20social)\b", 0.4,
    ),
    Kind(
        "passport", r"(?<![0-9A-Za-z])[A-Z]{1,2}[0-9]{6,8}(?![0-9A-Za-z])", "",
        r"(?i)\b(?:passport|reisepass|ausweis|pasaporte|passeport)\b", 0.3,
    ),
    Kind(
        "account", r"(?<![0-9A-Za-z.,+/-])[0-9]{7,12}(?![0-9A-Za-z]|[.,/-][0-9])", "",
        r"(?i)\b(?:account|acct|bank|konto|kontonummer|cuenta|compte)\b", 0.35,
    ),
]
BASE = ["email", "ip", "card", "phone"]


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(values, F.lit(0), lambda total, v: total + v) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number passes the mod-97 check."""
    bare = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substring(bare, 5, 100), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda total, c: (total * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97,
    )
    return rest == 1


def confirmed(kind: str, match: Column) -> Column:
    """Whether a match of a kind's pattern passes its check."""
    digits = _digits(match)
    if kind == "ip":
        # Parts of any length: at most 255 after leading zeros.
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_like(p, F.lit("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return F.when(F.length(F.regexp_replace(match, " ", "")).between(15, 34), mod97(match)).otherwise(False)
    if kind == "tel":
        return F.length(digits).between(7, 13)
    if kind == "taxid":
        # No part is all zeros, and some first parts were never given out.
        return ~F.regexp_like(match, F.lit("^(?:000|666|9[0-8])|-00-|-0000$"))
    return F.lit(True)


# The least score of a span of an added kind, and what a word nearby and digits beside a match change.
LEAST_SCORE, WORD_NEARBY, INSIDE_DIGITS = 0.5, 0.2, 0.3


def score_of(kind: Kind, before: Column, after: Column) -> Column:
    """The kind's prior, more with a word nearby that speaks for it, less inside a longer run of digits."""
    near = F.regexp_like(F.concat_ws(" ", before, after), F.lit(kind.words))
    inside = F.regexp_like(before, F.lit("[0-9]$")) | F.regexp_like(after, F.lit("^[0-9]"))
    score = F.lit(kind.prior) + F.when(near, WORD_NEARBY).otherwise(0.0) - F.when(inside, INSIDE_DIGITS).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)


def _matches(kind: Kind, text: Column) -> Column:
    """The matches of a kind's pattern in a text."""
    any_at_all = F.contains(text, F.lit(kind.needs)) if kind.needs else F.regexp_like(text, F.lit("[0-9][ -]?[0-9]"))
    none = F.array().cast("array<string>")
    return F.when(any_at_all, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))).otherwise(none)


def _with_gaps(kind: str, matches: Column, text: Column, pattern: str) -> Column:
    """The matches as structs, with the length of the gap before each and the text around it."""
    gaps = F.split(text, pattern, -1)
    sides = F.zip_with(
        F.slice(gaps, 1, F.size(matches)),
        F.slice(gaps, 2, F.size(matches)),
        lambda b, a: F.struct(
            F.length(b).alias("gap"), F.right(b, F.lit(NEARBY)).alias("before"), F.left(a, F.lit(NEARBY)).alias("after")
        ),
    )
    pairs = F.zip_with(matches, sides, lambda m, s: F.struct(m.alias("match"), s.alias("sides")))
    parts = F.transform(
        pairs,
        lambda p, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("at"), p["match"].alias("match"), p["sides"]["gap"].alias("gap"),
            p["sides"]["before"].alias("before"), p["sides"]["after"].alias("after"),
        ),
    )
    kinds = "array<struct<kind:string,at:int,match:string,gap:int,before:string,after:string>>"
    return F.when(F.size(matches) > 0, parts.cast(kinds)).otherwise(F.array().cast(kinds))


def proposals(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, kind, start, end, match, before and after of every match in `docs`.

    `docs` has doc_id, text_key and text. Rows alike in doc_id and text count once.
    """
    found = docs.select(
        "doc_id", "text_key", "text", *[_matches(k, F.col("text")).alias(f"m_{k.name}") for k in KINDS]
    )
    parts = [_with_gaps(k.name, F.col(f"m_{k.name}"), F.col("text"), k.pattern) for k in KINDS]
    # An outer explode, as an inner one would search every text twice, once for a filter in front of it.
    rows = found.select("doc_id", "text_key", F.explode_outer(F.concat(*parts)).alias("part"))
    rows = rows.where("part is not null").select("doc_id", "text_key", "part.*")
    rows = rows.dropDuplicates(["doc_id", "text_key", "kind", "at"])
    # The matches of one text and kind in order; their number is bounded by the text's length.
    order = Window.partitionBy("doc_id", "text_key", "kind").orderBy("at")
    end = F.sum(F.col("gap") + F.length("match")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", end.cast("long"))
    return rows.withColumn("start", F.col("end") - F.length("match")).drop("at", "gap")


def spans(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """doc_id, text_key, kind, start, end, match and score of all confirmed spans.

    The score is that of `score_of`. Spans of the added kinds need `least_score`, which numbers that are nothing by themselves
    reach only with a word nearby; base kinds always stay. Spans of different kinds may overlap.
    """
    rows = proposals(docs)
    good, score = F.lit(False), F.lit(0.0)
    for kind in KINDS:
        own = F.col("kind") == kind.name
        good = F.when(own, confirmed(kind.name, F.col("match"))).otherwise(good)
        score = F.when(own, score_of(kind, F.col("before"), F.col("after"))).otherwise(score)
    rows = rows.where(good).withColumn("score", score)
    rows = rows.where(F.col("kind").isin(BASE) | (F.col("score") >= least_score))
    return rows.select("doc_id", "text_key", "kind", "start", "end", "match", "score")


def _prepared(df: DataFrame, id_column: str, text: str) -> DataFrame:
    return df.select(
        F.col(id_column).cast("long").alias("doc_id"), text_key(text).alias("text_key"), text_or_empty(text).alias("text")
    )


def find_personal_data(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, and per row the sorted array of its spans (start, rank of the kind, end, kind, score).

    Places are code points, the end is exclusive. Null and empty texts have none. Every row of the input gives
    a row, also rows without an id and repeated ones.
    """
    docs = _prepared(df, id_column, text)
    rank = F.array_position(F.array(*[F.lit(k.name) for k in KINDS]), F.col("kind"))
    listed = (
        spans(docs)
        .groupBy("doc_id", "text_key")
        .agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind", "score"))).alias("spans"))
    )
    plain = docs.select("doc_id", "text_key").alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_key") == F.col("s.text_key"))
    joined = plain.join(listed.alias("s"), same, "left")
    return joined.select(
        "d.doc_id", "d.text_key", F.coalesce("s.spans", F.array().cast(listed.schema["spans"].dataType)).alias("spans")
    )


def _placeholder(kind: Kind, least_score: float, match: Column, before: Column, after: Column) -> Column:
    sure = confirmed(kind.name, match)
    if kind.name not in BASE:
        sure = sure & (score_of(kind, F.right(before, F.lit(NEARBY)), F.left(after, F.lit(NEARBY))) >= least_score)
    return F.when(sure, f"[{kind.name.upper()}]").otherwise(match)


def _shown(kind: Kind, least_score: float, sides: Column, match: Column) -> Column:
    """A gap and what stands for the match behind it; the last gap has none."""
    after = F.coalesce(sides["after"], F.lit(""))
    shown = F.when(match.isNotNull(), _placeholder(kind, least_score, match, sides["before"], after)).otherwise("")
    return F.concat(sides["before"], shown)


def redacted(df: DataFrame, text: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows with every span replaced by a placeholder such as [EMAIL], kind after kind.

    A later kind is searched in what earlier ones left, so overlapping matches are replaced once. Account numbers with
    a country come first, as they are longer, then the base kinds, then those that need a word nearby.
    Null texts stay null. No shuffle.
    """
    ibans = [k for k in KINDS if k.name == "iban"]
    base = [k for k in KINDS if k.name in BASE]
    for kind in [*ibans, *base, *[k for k in KINDS if k not in ibans and k not in base]]:
        own = F.col(text)
        matches, gaps = _matches(kind, F.coalesce(own, F.lit(""))), F.split(own, kind.pattern, -1)
        sides = F.arrays_zip(gaps.alias("before"), F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("after"))
        whole = F.array_join(
            F.zip_with(sides, matches, partial(_shown, kind, least_score)), ""
        )
        df = df.withColumn(text, F.when(F.size(matches) > 0, whole).otherwise(own))
    return df
