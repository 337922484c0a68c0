"""Commit subjects and version numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules


def _group(subject: Column, index: int) -> Column:
    return F.nullif(F.regexp_extract(subject, rules.COMMIT_REGEX, index), F.lit(""))


def commit_type(subject: Column) -> Column:
    return F.coalesce(_group(subject, 1), F.lit(rules.DEFAULT_COMMIT_TYPE))


def commit_scope(subject: Column) -> Column:
    return F.coalesce(_group(subject, 2), F.lit(""))


def commit_breaking(subject: Column) -> Column:
    marked = _group(subject, 3).isNotNull() | F.contains(subject, F.lit(rules.BREAKING_MARK))
    return F.coalesce(marked, F.lit(False))


def changelog_text(subject: Column) -> Column:
    """The subject without its first ``prefix:``, conventional or not."""
    return F.regexp_replace(subject, rules.COMMIT_PREFIX_REGEX, "")


def changelog_section(kind: Column, breaking: Column) -> Column:
    return (
        F.when(breaking, "breaking")
        .when(kind == "feat", "features")
        .when(kind.isin("fix", "perf"), "fixes")
        .when(kind == "docs", "docs")
        .otherwise("chore")
    )


def bump_list(kind: Column, breaking: Column) -> Column:
    """Which of the three lists of a version analysis a commit belongs to."""
    return F.when(breaking, "breaking").when(kind == "feat", "features").when(kind == "fix", "fixes")


def version_part(version: Column, index: int) -> Column:
    """A dotted part as a number; anything that is no number counts as 0."""
    return F.coalesce(F.get(F.split(version, "[.]"), F.lit(index)).try_cast("bigint"), F.lit(0))


def next_version(version: Column, bump: Column) -> Column:
    major, minor, patch = (version_part(version, i) for i in range(3))
    return (
        F.when(bump == "major", F.concat((major + 1).cast("string"), F.lit(".0.0")))
        .when(bump == "minor", F.concat_ws(".", major, minor + 1, F.lit("0")))
        .when(bump == "patch", F.concat_ws(".", major, minor, patch + 1))
        .otherwise(version)
    )


def bump_confidence(breaking: Column, features: Column, fixes: Column) -> Column:
    """0 to 100 from the number of commits in each list."""

    def points(condition: Column, n: int) -> Column:
        return F.when(condition, n).otherwise(0)

    raw = (
        F.lit(rules.CONFIDENCE_BASE)
        + points(breaking > 0, rules.CONFIDENCE_BREAKING)
        + points(features > 0, rules.CONFIDENCE_FEATURES)
        + points(fixes > 0, rules.CONFIDENCE_FIXES)
        + points(breaking + features + fixes == 0, rules.CONFIDENCE_NO_REASON)
    )
    return F.least(F.lit(100), F.greatest(F.lit(0), raw))


def valid_version(version: Column) -> Column:
    return version.rlike(rules.VERSION_REGEX)
