"""Secret scanning: lines, pattern hits, entropy, allow lists, diffs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.matching import HIT_NAMES, HIT_SCHEMA, Matcher, hit_batches
from ..functions.prefilter import may_match, portable
from ..functions.scoring import diff_risk, severity_rank
from ..functions.text import located_matches, located_matches_sql, matches_any_glob
from ..rules import SecretPattern
from ..session import ship_package, small_table, stored
from .pieces import running

DIFF_KEY = ["file", "line", "column", "pattern_name"]
PROJECT = "project_id"


def with_project(key: Sequence[str], *tables: DataFrame) -> list[str]:
    """The key with the project in front, if all tables carry it: a path is one file per project."""
    return [*([PROJECT] if all(PROJECT in t.columns for t in tables) else []), *key]


def _without(df: DataFrame, other: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of ``df`` whose key is not in ``other``; a null project is one project."""
    names = with_project(key, df, other)
    found = other.select(*[F.col(c).alias(f"other {c}") for c in names]).distinct()
    return df.join(found, [F.col(c).eqNullSafe(F.col(f"other {c}")) for c in names], "left_anti")


def pattern_table(spark, patterns: Sequence[SecretPattern]) -> DataFrame:
    """Patterns as a table."""
    text = ["name", "regex", "description", "severity"]
    columns = {name: pa.string() for name in text} | {"entropy": pa.float64()}
    return small_table(spark, columns, [tuple(getattr(p, c) for c in columns) for p in patterns])


def all_patterns(
    default: Sequence[SecretPattern], custom: Sequence[SecretPattern]
) -> list[SecretPattern]:
    """Built-in and user patterns together, duplicates kept."""
    return [*default, *custom]


def scanned_files(
    files: DataFrame,
    include: Sequence[str] = tuple(rules.DEFAULT_INCLUDE),
    exclude: Sequence[str] = tuple(rules.DEFAULT_EXCLUDE),
    max_size: int | None = None,
) -> DataFrame:
    """The files a scan looks at: included, not excluded, not above the size limit."""
    chosen = files.filter(
        matches_any_glob(F.col("file"), list(include))
        & ~matches_any_glob(F.col("file"), list(exclude))
    )
    if max_size is not None:
        chosen = chosen.filter(F.col("size") <= max_size)
    return chosen


def scan_coverage(
    files: DataFrame, include: Sequence[str], exclude: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Share of files that a scan with these globs looks at."""
    scanned = matches_any_glob(F.col("file"), list(include)) & ~matches_any_glob(
        F.col("file"), list(exclude)
    )
    return files.groupBy(*by).agg(
        F.count("*").alias("files"),
        F.count_if(scanned).alias("scanned"),
        F.avg(scanned.cast("int")).alias("coverage"),
    )


def split_lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1; the other columns of the file are kept."""
    rest = [c for c in files.columns if c != "content"]
    return files.select(*rest, F.posexplode(F.split("content", "\r?\n")).alias("pos", "text")).select(
        *rest, (F.col("pos") + 1).alias("line"), "text"
    )


def regexes(patterns: Sequence[SecretPattern], tokens: bool = False) -> list[str]:
    """What a scan looks for: the patterns and, if wanted, long tokens."""
    return [p.regex for p in patterns] + ([rules.TOKEN_REGEX] if tokens else [])


def suspect_files(files: DataFrame, patterns: Sequence[SecretPattern]) -> DataFrame:
    """Files that may hold a finding.

    A pattern that depends on the ends of a line or on its surroundings cannot
    be tested on a whole file; then all files are kept.
    """
    wanted = regexes(patterns, tokens=True)
    if not all(portable(r) for r in wanted):
        return files
    return files.filter(may_match(F.col("content"), wanted))


def located_elsewhere(patterns: Sequence[SecretPattern]) -> Column | None:
    """Hits of the patterns that only the JVM can read, as (no, column, value); None if there are none."""

    def of(no: int, pattern: SecretPattern) -> Column:
        hits = located_matches("text", pattern.regex)
        return F.transform(hits, lambda h: F.struct(F.lit(no).alias("no"), h["column"], h["value"]))

    arrays = [of(no, p) for no, p in enumerate(patterns) if not portable(p.regex)]
    return F.concat(*arrays) if arrays else None


def _find(lines: DataFrame, matcher: Matcher) -> DataFrame:
    """One row per hit of the lines, narrow: a first test of whole batches, then the lines that pass it.

    The column ``text`` gives way to the hit with an excerpt of the line around it, or with the line, as the matcher says.
    """
    ship_package(lines.sparkSession)
    rest = [c for c in lines.columns if c not in ("text", *HIT_NAMES)]
    located = located_elsewhere(matcher.patterns)
    more = [] if located is None else [located.alias("located")]
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields if f.name in rest]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return hit_batches(batches, lambda batch: [(matcher, None)], rest)

    read = lines.select(*[f"`{c}`" for c in rest], F.make_valid_utf8("text").alias("text"), *more)
    return read.mapInArrow(find, ", ".join([*types, HIT_SCHEMA]))


def match_patterns(
    lines: DataFrame, patterns: Sequence[SecretPattern] = tuple(rules.DEFAULT_PATTERNS), whole_lines: bool = False
) -> DataFrame:
    """Findings of the named patterns; most lines fail the first test."""
    return _find(lines, Matcher(tuple(patterns), whole_lines=whole_lines))


def high_entropy_tokens(
    lines: DataFrame,
    threshold: float = rules.ENTROPY_THRESHOLD,
    patterns: Sequence[SecretPattern] = tuple(rules.DEFAULT_PATTERNS),
) -> DataFrame:
    """Long random-looking tokens that no named pattern explains."""
    return _find(lines, Matcher(tuple(patterns), named=False, tokens=True, threshold=threshold))


def all_hits(
    lines: DataFrame, patterns: Sequence[SecretPattern], threshold: float = rules.ENTROPY_THRESHOLD,
    whole_lines: bool = False,
) -> DataFrame:
    """Hits of named patterns and long tokens in one pass over the lines, without those of too low entropy."""
    return _find(lines, Matcher(tuple(patterns), tokens=True, threshold=threshold, whole_lines=whole_lines))


PATTERN_FIELDS = ["name", "regex", "severity", "entropy"]


def pattern_sets(patterns: DataFrame, by: str = PROJECT) -> DataFrame:
    """One row per project with all its patterns, from rows ``(project, seq, name, regex, severity, entropy)``.

    The lists are configuration, a few patterns per project; they are ordered by ``seq``, and rows without a regex are left out.
    """
    rows = patterns.where(F.col("regex").isNotNull()).select(
        by, F.struct(F.col("seq").cast("long").alias("seq"), *[F.col(c) for c in PATTERN_FIELDS]).alias("row")
    )
    listed = rows.groupBy(by).agg(F.array_sort(F.collect_list("row")).alias("patterns"))
    return listed.select(by, F.transform("patterns", lambda p: F.struct(*[p[c].alias(c) for c in PATTERN_FIELDS])).alias("patterns"))


def as_set(patterns: Sequence[SecretPattern]) -> Column:
    """A list of patterns as a value of the column ``patterns``."""
    fields = [F.struct(*[F.lit(getattr(p, c)).cast("double" if c == "entropy" else "string").alias(c) for c in PATTERN_FIELDS]) for p in patterns]
    return F.array(*fields) if fields else F.expr("cast(array() as array<struct<name:string,regex:string,severity:string,entropy:double>>)")


# The column that tells pattern sets apart.
SET_KEY = "patterns_key"


def set_key(patterns: Column) -> Column:
    """Equal for equal lists of patterns."""
    return F.sha2(F.to_json(patterns), 256)


class _Matchers:
    """The compiled pattern sets a task has met, by their key; the one used longest ago goes first.

    A list comes with the rows of its key, or from ``sets``, which knows all lists.
    """

    KEPT = 1000

    def __init__(self, sets: _Sets | None = None, **kinds) -> None:
        self.sets, self.kinds, self.known = sets, kinds, {}

    def of(self, key: str, listed: Callable[[], list[dict] | None]) -> Matcher:
        matcher = self.known.pop(key, None)
        if matcher is None:
            if len(self.known) >= self.KEPT:
                del self.known[next(iter(self.known))]
            matcher = Matcher(tuple(SecretPattern(p["name"], p["regex"], p["severity"], "", p["entropy"]) for p in listed() or []), **self.kinds)
        self.known[key] = matcher
        return matcher

    def groups(self, batch: pa.RecordBatch) -> list[tuple[Matcher, pa.Array]]:
        """The rows of a batch by their pattern set; the list itself is read where its key is new."""
        lists = None if self.sets else batch.column("patterns")

        def met(key: str, i: int) -> Matcher:
            return self.of(key, lists[i].as_py if lists is not None else lambda: self.sets.of(key))

        of: dict[str, tuple[Matcher, list[int]]] = {}
        for i, key in enumerate(batch.column(SET_KEY).to_pylist()):
            if key not in of:
                of[key] = (met(key, i), [])
            of[key][1].append(i)
        # The set of the last row is the one that the next batch may go on with.
        if len(batch):
            met(key, i)
        return [(matcher, pa.array(rows, pa.int64())) for matcher, rows in of.values()]


class _Sets:
    """What to search for with each set, read from a table ``(patterns_key, no, regex, least)`` in the order of its keys.

    Its patterns have their number as their name, no severity, and the least limit of those that share the regex.
    """

    def __init__(self, table: bytes) -> None:
        self.rows = pa.ipc.open_stream(table).read_all().combine_chunks()
        self.places: dict[str, tuple[int, int]] = {}
        for i, key in enumerate(self.rows.column(SET_KEY).to_pylist()):
            self.places[key] = (self.places.get(key, (i, 0))[0], i + 1)

    def of(self, key: str) -> list[dict]:
        start, end = self.places.get(key, (0, 0))
        return [
            {"name": row["no"], "regex": row["regex"], "severity": None, "entropy": row["least"]}
            for row in self.rows.slice(start, end - start).to_pylist()
        ]


# Hits of the patterns of a row that are not portable, each with a regex of its own.
_LOCATED_BY_ROW = f"""
flatten(transform(slow, p -> transform({located_matches_sql('text', 'p.regex')},
  h -> struct(p.no as no, h.column as column, h.value as value))))
"""
_SLOW = pa.list_(pa.struct([("no", pa.int32()), ("regex", pa.string())]))


def _types(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names]


def _suspect_rows(files: DataFrame, matchers_of: Callable[[], _Matchers], slow: bool) -> DataFrame:
    """Files that may hold a hit of their own patterns or a long token; with ``slow`` also their patterns that only the JVM can read, one of each regex.

    Rows pass in batches of bounded size. A Python function in a filter would have Spark keep the rows of a batch, however long, on disk.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = matchers_of()
        for batch in batches:
            found = np.ones(len(batch), bool)
            located: list[list[dict]] = [[]] * len(batch)
            texts = batch.column("content")
            for matcher, rows in matchers.groups(batch):
                if None not in matcher.regexes:
                    found[rows.to_numpy()] = matcher.suspects(texts.take(rows)).to_numpy(zero_copy_only=False)
                elif slow:
                    own = [{"no": no, "regex": matcher.patterns[no].regex} for no, r in enumerate(matcher.regexes) if r is None and matcher.first[no] == no]
                    for i in rows.to_pylist():
                        located[i] = own
            more = [pa.array([located[i] for i in np.flatnonzero(found)], _SLOW)] if slow else []
            kept = batch.filter(pa.array(found))
            if len(kept):
                yield pa.RecordBatch.from_arrays([*kept.columns, *more], names=[*kept.schema.names, *["slow"] * slow])

    read = files.withColumn("content", F.make_valid_utf8("content"))
    more = ["slow array<struct<no:int,regex:string>>"] * slow
    return read.mapInArrow(keep, ", ".join([*_types(read, read.columns), *more]))


def scan_with_sets(
    files: DataFrame, tokens: bool = True, threshold: float = rules.ENTROPY_THRESHOLD
) -> DataFrame:
    """Findings of files ``(file, content, patterns, ...)`` that bring their own patterns.

    A set is compiled once per task and goes with the first line of a file; ``patterns_key``, if there, is its ``set_key``. Files
    that can match nothing are dropped before they are cut into lines. Rows with null or no patterns are searched for tokens alone. Regexes that
    only the JVM can read, such as those with look-around, are located there.
    """
    ship_package(files.sparkSession)
    listed = files.drop("slow").withColumn("patterns", F.coalesce("patterns", as_set([])))
    if SET_KEY not in listed.columns:
        listed = listed.withColumn(SET_KEY, set_key(F.col("patterns")))
    lines = split_lines(_suspect_rows(listed, lambda: _Matchers(tokens=tokens), slow=True))
    rest = [c for c in lines.columns if c not in ("text", "patterns", SET_KEY, "slow", *HIT_NAMES)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = _Matchers(tokens=tokens, threshold=threshold)
        return hit_batches(batches, matchers.groups, rest)

    text = F.make_valid_utf8("text").alias("text")
    once = F.when(F.col("line") == 1, F.col("patterns")).alias("patterns")
    read = lines.select(*[f"`{c}`" for c in rest], text, SET_KEY, once, F.expr(_LOCATED_BY_ROW).alias("located"))
    return read.mapInArrow(find, ", ".join([*_types(lines, rest), HIT_SCHEMA]))


def pattern_rows(sets: DataFrame) -> DataFrame:
    """Sets ``(patterns_key, patterns)`` as one row per pattern, sets of one key as one.

    ``no`` is the place of the first pattern of the same regex, as text; ``slow`` says that only the JVM can read the regex.
    """

    @F.arrow_udf("boolean")
    def unread(regexes: pa.Array) -> pa.Array:
        known = {regex: not portable(regex) for regex in regexes.unique().to_pylist()}
        return pa.array([known[regex] for regex in regexes.to_pylist()], pa.bool_())

    ship_package(sets.sparkSession)
    rows = sets.dropDuplicates([SET_KEY]).select(SET_KEY, F.posexplode("patterns").alias("pos", "p")).select(SET_KEY, "pos", "p.*")
    first = F.min("pos").over(Window.partitionBy(SET_KEY, "regex"))
    return rows.select(SET_KEY, first.cast("string").alias("no"), *PATTERN_FIELDS, unread("regex").alias("slow"))


def hits_by_key(
    files: DataFrame, listed: DataFrame, tokens: bool = True, threshold: float = rules.ENTROPY_THRESHOLD
) -> DataFrame:
    """Hits in files ``(file, content, patterns_key, ...)``, each regex of a set searched for once; ``named_hits`` makes findings of them.

    ``listed``, the ``pattern_rows`` of all sets as a written table, goes to every task, so no row of a file carries its list; a
    key without rows is searched for tokens alone. Hits below all limits of their regex are left out.
    """
    spark = files.sparkSession
    ship_package(spark)
    least = F.min(F.coalesce("entropy", F.lit(threshold).cast("double")))
    searched = listed.groupBy(SET_KEY, "no").agg(F.first("regex").alias("regex"), least.alias("least"), F.first("slow").alias("slow"))
    table = searched.orderBy(SET_KEY, F.col("no").cast("int")).toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    sent = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    gated = _suspect_rows(files, lambda: _Matchers(_Sets(sent.value), tokens=tokens), slow=False)
    lines = split_lines(gated)
    rest = [c for c in lines.columns if c not in ("text", *HIT_NAMES)]
    more = []
    if any(table.column("slow").to_pylist()):
        # The number of a hit located by the JVM is its regex's place among those of the set that are searched for.
        places = F.array_sort(F.collect_list(F.struct(F.col("no").cast("int").alias("place"), "regex", "slow")))
        every = F.transform(places, lambda p, no: F.struct(no.alias("no"), p["regex"].alias("regex"), p["slow"].alias("slow")))
        slow = F.filter(every, lambda p: p["slow"]).alias("slow")
        lists = stored(searched.groupBy(F.col(SET_KEY).alias("slow of")).agg(slow).where(F.size("slow") > 0), "slow-patterns")
        lines = lines.join(F.broadcast(lists), F.col(SET_KEY) == F.col("slow of"), "left")
        more = [F.expr(_LOCATED_BY_ROW).alias("located")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = _Matchers(_Sets(sent.value), tokens=tokens, threshold=threshold)
        return hit_batches(batches, matchers.groups, rest)

    read = lines.select(*[f"`{c}`" for c in rest], F.make_valid_utf8("text").alias("text"), *more)
    return read.mapInArrow(find, ", ".join([*_types(lines, rest), HIT_SCHEMA]))


def named_hits(hits: DataFrame, listed: DataFrame, threshold: float = rules.ENTROPY_THRESHOLD) -> DataFrame:
    """Findings of the hits of ``hits_by_key``: one for each pattern of the regex, without those below the limit of theirs."""
    own = listed.select(*[F.col(c).alias(f"own {c}") for c in (SET_KEY, "no", "name", "severity", "entropy")])
    number = F.col("own no")
    joined = hits.join(
        F.broadcast(own), (F.col(SET_KEY) == F.col(f"own {SET_KEY}")) & (F.col("pattern_name") == number), "left"
    )
    if threshold is not None:
        joined = joined.where(number.isNull() | (F.col("entropy") >= F.coalesce("own entropy", F.lit(threshold))))
    filled = {"pattern_name": "own name", "severity": "own severity", "pattern_entropy": "own entropy"}
    return joined.select(
        *[F.when(number.isNotNull(), F.col(filled[c])).otherwise(F.col(c)).alias(c) if c in filled else F.col(f"`{c}`") for c in hits.columns if c != SET_KEY]
    )


def entropy_filter(findings: DataFrame, threshold: float = rules.ENTROPY_THRESHOLD) -> DataFrame:
    """Drop findings below the entropy of their pattern, or else the threshold."""
    return findings.filter(
        F.col("entropy") >= F.coalesce(F.col("pattern_entropy"), F.lit(threshold))
    )


def apply_allowlist(findings: DataFrame, allowed: DataFrame) -> DataFrame:
    """Drop findings whose value is an allowed secret."""
    return findings.join(allowed.select("value"), "value", "left_anti")


def clean_files(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Files without any finding, by project and path; the contents stay out of the shuffle."""
    return _without(files.drop("content"), findings, ["file"])


def severity_rollup(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of findings and of files per severity; one path in two projects is two files."""
    file = [c for c in with_project(["file"], findings) if c not in by]
    per_file = findings.groupBy(*by, "severity", *file).agg(F.count("*").alias("n"))
    return per_file.groupBy(*by, "severity").agg(
        F.sum("n").alias("findings"), F.count("*").alias("files")
    )


def severity_members(findings: DataFrame) -> DataFrame:
    """The findings from critical to low; a distributed sort, one row per member."""
    return findings.orderBy(
        F.desc(severity_rank(F.col("severity"))), "file", "line", "column", "pattern_name"
    )


def secret_diff(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """What changed between two scans, one row per project, position and pattern, with today's severity if there is one.

    Both scans are reduced to one row per key before they meet, in one shuffle.
    """

    key = with_project(DIFF_KEY, current, baseline)

    def side(df: DataFrame, prefix: str, other: str) -> DataFrame:
        missing = F.lit(None).cast("string")
        return df.select(
            *key,
            F.col("severity").alias(f"{prefix}severity"),
            F.col("value").alias(f"{prefix}value"),
            missing.alias(f"{other}severity"),
            missing.alias(f"{other}value"),
        )

    both = side(current, "", "old_").unionByName(side(baseline, "old_", ""))
    merged = both.groupBy(*key).agg(
        F.coalesce(F.max("severity"), F.max("old_severity")).alias("severity"),
        F.max("value").alias("value"),
        F.max("old_value").alias("old_value"),
    )
    change = (
        F.when(F.col("old_value").isNull(), "added")
        .when(F.col("value").isNull(), "removed")
        .when(F.col("value") != F.col("old_value"), "modified")
        .otherwise("unchanged")
    )
    return merged.withColumn("change", change)


def secret_diff_summary(diff: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals per kind of change and the risk of what was added or modified."""
    added, modified = F.col("change") == "added", F.col("change") == "modified"
    counts = diff.groupBy(*by).agg(
        F.count_if(added).alias("total_added"),
        F.count_if(F.col("change") == "removed").alias("total_removed"),
        F.count_if(modified).alias("total_modified"),
        F.count_if(F.col("change") == "unchanged").alias("total_unchanged"),
        F.count_if(added & (F.col("severity") == "critical")).alias("_critical"),
        F.count_if(added & (F.col("severity") == "high")).alias("_high"),
    )
    risk = diff_risk(
        F.col("_critical"), F.col("_high"), F.col("total_added") + F.col("total_modified")
    )
    return counts.withColumn("risk_level", risk).drop("_critical", "_high")


def added_findings(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose position and pattern are new."""
    return _without(current, baseline, DIFF_KEY)


def removed_findings(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings that are gone."""
    return _without(baseline, current, DIFF_KEY)


def baseline_as_of(
    scans: DataFrame, since: Column | None = None, version: str | None = None
) -> DataFrame:
    """Per project the newest scan not after ``since``, or of one version."""
    chosen = scans
    if since is not None:
        chosen = chosen.filter(F.col("scan_ts") <= since)
    if version is not None:
        chosen = chosen.filter(F.col("version") == version)
    newest = F.max_by(F.struct("scan_id", "scan_ts", "version"), F.struct("scan_ts", "scan_id"))
    return chosen.groupBy("project_id").agg(newest.alias("scan")).select("project_id", "scan.*")


def baselines_as_of(scans: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """For every cut-off ``(project_id, since, ...)`` the newest scan of its project not after it.

    An as-of join: scans and cut-offs lie in one order and each cut-off takes the last scan before it, so a project may
    have any number of both and spreads over tasks. Of scans at one time the one with the greatest id counts;
    a cut-off without an earlier scan, or without a time, has nulls.
    """
    scan = F.struct("scan_id", "scan_ts", "version")
    cut = F.struct(*[F.col(c) for c in cutoffs.columns])
    absent_scan = F.lit(None).cast(scans.select(scan.alias("s")).schema["s"].dataType)
    absent_cut = F.lit(None).cast(cutoffs.select(cut.alias("c")).schema["c"].dataType)
    at_scan = scans.where("scan_ts is not null").select(
        "project_id", F.col("scan_ts").alias("at"), F.lit(0).alias("kind"), F.col("scan_id").alias("tie"),
        scan.alias("scan"), absent_cut.alias("cut"),
    )
    at_cut = cutoffs.select(
        "project_id", F.col("since").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(scans.schema["scan_id"].dataType).alias("tie"),
        absent_scan.alias("scan"), cut.alias("cut"),
    )
    carried = running(at_scan.unionByName(at_cut), ["project_id"], ["at", "kind", "tie"], ["scan"])
    return carried.where("kind = 1").select("cut.*", "scan.*")


def finding_lifetimes(
    scans: DataFrame, findings: DataFrame, key: Sequence[str] = ("file", "pattern_name", "value")
) -> DataFrame:
    """When each finding came, went and came back: one row per unbroken run of scans that hold it.

    ``scans(project_id, scan_id, scan_ts)`` are all scans, also those without findings; ``findings`` has
    project_id, scan_id and the key. ``fixed_at`` is the time of the first scan without it, null while it is
    open; ``occurrence`` counts the runs of a finding, from 1. A finding counts once per scan.
    """
    every = scans.select("project_id", "scan_id", "scan_ts").distinct()
    numbered = running(every, ["project_id"], ["scan_ts", "scan_id"])
    held = findings.select("project_id", "scan_id", *key).distinct().join(numbered, ["project_id", "scan_id"])
    same = Window.partitionBy("project_id", *key)
    runs = held.withColumn("run", F.col("n") - F.row_number().over(same.orderBy("n")))
    lives = runs.groupBy("project_id", *key, "run").agg(
        F.min("scan_ts").alias("introduced_at"), F.max("scan_ts").alias("last_seen_at"),
        F.count("*").alias("scans"), (F.max("n") + 1).alias("n"),
    )
    after = numbered.select("project_id", "n", F.col("scan_ts").alias("fixed_at"))
    occurrence = F.row_number().over(same.orderBy("run"))
    return lives.withColumn("occurrence", occurrence).join(after, ["project_id", "n"], "left").select(
        "project_id", *key, "occurrence", F.when(F.col("occurrence") == 1, "introduced").otherwise("reintroduced").alias("event"),
        "introduced_at", "last_seen_at", "fixed_at", "scans",
    )


def added_copies(current: DataFrame, baseline: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Whole rows that ``current`` holds more often than ``baseline``, as often as they are more.

    Beside ``added_findings``, which knows a finding by its place: here a secret that was there once and
    is there three times now is two rows.
    """
    names = list(columns or current.columns)
    return current.select(*names).exceptAll(baseline.select(*names))


def false_positive_rate(findings: DataFrame, allowed: DataFrame) -> DataFrame:
    """Share of findings per pattern that the allow list suppresses."""
    marks = allowed.select("value").distinct().withColumn("is_allowed", F.lit(True))
    return (
        findings.join(marks, "value", "left")
        .groupBy("pattern_name")
        .agg(
            F.count("*").alias("findings"),
            F.avg(F.col("is_allowed").isNotNull().cast("int")).alias("false_positive_rate"),
        )
    )


def secret_audit_history(snapshots: DataFrame) -> DataFrame:
    """Findings per scan and severity over time."""
    return snapshots.groupBy("scan_ts", "severity").agg(F.count("*").alias("findings"))
