"""The secret scan and the hooks around it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions.matching import Matcher
from ..operators import secrets as s
from ..rules import SecretPattern
from ..session import is_small, small_side, stored
from ..sources.files import number_lines, read_lines

Hook = Callable[[DataFrame], DataFrame]


def secret_scan(
    files: DataFrame,
    patterns: Sequence[SecretPattern] = tuple(rules.DEFAULT_PATTERNS),
    allowed: DataFrame | None = None,
    threshold: float = rules.ENTROPY_THRESHOLD,
    pre_scan: Hook | None = None,
    post_scan: Hook | None = None,
    whole_lines: bool = False,
) -> DataFrame:
    """Findings of a scan over ``files(file, content, ...)``; their context is an excerpt or, with ``whole_lines``, the line.

    Files that can match nothing are dropped before they are cut into lines. All
    steps are narrow; only a large allow list can bring a shuffle, and then of
    findings, not of files.
    """
    if pre_scan is not None:
        files = files.transform(pre_scan)
    lines = s.split_lines(s.suspect_files(files, patterns))
    findings = s.all_hits(lines, patterns, threshold, whole_lines).drop("pattern_entropy")
    if allowed is not None:
        findings = s.apply_allowlist(findings, allowed)
    if post_scan is not None:
        findings = findings.transform(post_scan)
    return findings


def scan_lines(
    lines: DataFrame,
    patterns: Sequence[SecretPattern] = tuple(rules.DEFAULT_PATTERNS),
    allowed: DataFrame | None = None,
    threshold: float = rules.ENTROPY_THRESHOLD,
) -> DataFrame:
    """Findings in the lines of ``read_lines``: files of any size, by byte ranges.

    The text is read once; only lines that may hold a finding are written, numbered and matched.
    """
    matcher = Matcher(tuple(patterns), tokens=True, threshold=threshold)
    findings = s.all_hits(number_lines(lines, matcher), patterns, threshold).drop("pattern_entropy")
    return findings if allowed is None else s.apply_allowlist(findings, allowed)


def scan_folder(
    spark: SparkSession,
    root: str,
    patterns: Sequence[SecretPattern] = tuple(rules.DEFAULT_PATTERNS),
    allowed: DataFrame | None = None,
    threshold: float = rules.ENTROPY_THRESHOLD,
    include: Sequence[str] = tuple(rules.DEFAULT_INCLUDE),
    exclude: Sequence[str] = tuple(rules.DEFAULT_EXCLUDE),
    max_size: int | None = None,
) -> DataFrame:
    """Findings in the files below a folder, whatever their size."""
    return scan_lines(read_lines(spark, root, include, exclude, max_size), patterns, allowed, threshold)


def project_scan(
    files: DataFrame,
    patterns: DataFrame,
    default: Sequence[SecretPattern] = tuple(rules.DEFAULT_PATTERNS),
    allowed: DataFrame | None = None,
    threshold: float = rules.ENTROPY_THRESHOLD,
) -> DataFrame:
    """Findings where every project has patterns of its own beside the built-in ones.

    ``patterns(project_id, seq, name, regex, severity, entropy)``; a project with none is searched for the
    built-in ones alone, and a task compiles each list once. Lists and allowed values that are short in all go to every task, so that
    neither files nor findings are shuffled and a file carries the key of its list alone; allowed values are dropped before
    a hit becomes a finding of each pattern that shares its regex. Longer lists are joined to the files.
    """
    builtin = s.as_set(default)
    own = s.pattern_sets(patterns).select(F.col("project_id").alias("set of"), F.concat(builtin, "patterns").alias("own"))
    sets = stored(own.withColumn("own key", s.set_key(F.col("own"))), "pattern-sets")
    same = F.col("project_id").eqNullSafe(F.col("set of"))
    key = F.coalesce("own key", s.set_key(builtin)).alias(s.SET_KEY)
    rest = [F.col(f"`{c}`") for c in files.columns if c not in ("patterns", "slow", s.SET_KEY)]
    short = is_small(sets, F.length(F.to_json("own")))
    if short:
        spark = files.sparkSession
        plain = spark.range(1).select(s.set_key(builtin).alias(s.SET_KEY), builtin.alias("patterns"))
        lists = sets.select(F.col("own key").alias(s.SET_KEY), F.col("own").alias("patterns")).unionByName(plain)
        listed = stored(s.pattern_rows(lists), "patterns")
        keyed = files.join(F.broadcast(sets.select("set of", "own key")), same, "left").select(*rest, key)
        findings = s.hits_by_key(keyed, listed, threshold=threshold)
    else:
        every = files.join(sets, same, "left").select(*rest, F.coalesce("own", builtin).alias("patterns"), key)
        findings = s.scan_with_sets(every, threshold=threshold)
    if allowed is not None:
        values = stored(allowed.select("value").distinct(), "allowed")
        findings = s.apply_allowlist(findings, small_side(values, F.octet_length("value")))
    return (s.named_hits(findings, listed, threshold) if short else findings).drop("pattern_entropy")


def run_publish(
    packages: DataFrame, pre_publish: Hook, post_publish: Hook | None = None
) -> DataFrame:
    """Packages that pass the gate of ``pre_publish``, handed to ``post_publish``.

    ``pre_publish`` adds the boolean column ``passed``.
    """
    passed = packages.transform(pre_publish).filter(F.col("passed")).drop("passed")
    return passed if post_publish is None else passed.transform(post_publish)
