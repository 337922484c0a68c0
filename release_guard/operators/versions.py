"""Commits to version bumps and changelogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import versions as v
from ..functions.text import label_map
from .ordering import ordered_pages


def parse_commits(commits: DataFrame) -> DataFrame:
    """Add type, scope and the breaking mark read from the subject."""
    subject = F.col("subject")
    return commits.select(
        "*",
        v.commit_type(subject).alias("type"),
        v.commit_scope(subject).alias("scope"),
        v.commit_breaking(subject).alias("breaking"),
    )


def commits_since(commits: DataFrame, since: str) -> DataFrame:
    return commits.filter(F.col("commit_date") >= F.lit(since).cast("date"))


def source_file_changes(changes: DataFrame, path: str = "file") -> DataFrame:
    wanted = [F.col(path).endswith(s) for s in rules.SOURCE_SUFFIXES]
    condition = wanted[0]
    for other in wanted[1:]:
        condition = condition | other
    return changes.filter(condition)


def version_bump(commits: DataFrame) -> DataFrame:
    """Per repository the strongest bump and how many commits asked for each."""
    kind = v.bump_list(F.col("type"), F.col("breaking"))
    counted = parse_commits(commits).groupBy("repo").agg(
        F.count_if(kind == "breaking").alias("n_breaking"),
        F.count_if(kind == "features").alias("n_features"),
        F.count_if(kind == "fixes").alias("n_fixes"),
        F.count("*").alias("n_commits"),
    )
    rank = (
        F.when(F.col("n_breaking") > 0, 3)
        .when(F.col("n_features") > 0, 2)
        .when(F.col("n_fixes") > 0, 1)
        .otherwise(0)
    )
    return counted.withColumn("recommended_bump", label_map(rules.BUMP_BY_RANK, rank))


def version_reasons(commits: DataFrame) -> DataFrame:
    """The commits behind a bump, one row each, in log order by ``seq``."""
    kind = v.bump_list(F.col("type"), F.col("breaking"))
    return (
        parse_commits(commits)
        .select("repo", "seq", kind.alias("list"), "subject")
        .filter(F.col("list").isNotNull())
        .withColumn(
            "reason", F.concat(label_map(rules.REASON_PREFIX, F.col("list")), F.col("subject"))
        )
    )


def version_lists(commits: DataFrame, width: int = 1000) -> DataFrame:
    """The lists of breaking changes, features and fixes, in pages."""
    return ordered_pages(version_reasons(commits), ["repo", "list"], "seq", F.col("subject"), width)


def changelog_entries(commits: DataFrame) -> DataFrame:
    """One changelog entry per commit."""
    return parse_commits(commits).select(
        "repo",
        "seq",
        v.changelog_section(F.col("type"), F.col("breaking")).alias("section"),
        v.changelog_text(F.col("subject")).alias("entry"),
    )


def changelog_sections(commits: DataFrame, width: int = 1000) -> DataFrame:
    """The ordered entries of every section of every repository, in pages."""
    return ordered_pages(
        changelog_entries(commits), ["repo", "section"], "seq", F.col("entry"), width
    )


def with_next_version(bumps: DataFrame, current: Column) -> DataFrame:
    """Add the new version and the confidence to bumps."""
    return bumps.withColumn("new_version", v.next_version(current, F.col("recommended_bump"))).withColumn(
        "confidence",
        v.bump_confidence(F.col("n_breaking"), F.col("n_features"), F.col("n_fixes")),
    )
