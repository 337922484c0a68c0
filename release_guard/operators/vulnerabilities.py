"""Vulnerability filters, summaries and recommendations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.scoring import (
    map_severity,
    score_band,
    security_score,
    vulnerability_risk,
)
from .ordering import ordered_pages


def with_mapped_severity(vulns: DataFrame) -> DataFrame:
    return vulns.withColumn("severity", map_severity(F.col("severity")))


def filter_vulns_by_severity(vulns: DataFrame, severity: str) -> DataFrame:
    return vulns.filter(F.col("severity") == severity)


def filter_audit_level(vulns: DataFrame, level: str = "moderate") -> DataFrame:
    """Vulnerabilities of at least this severity."""
    wanted = [s for s in rules.VULN_SEVERITIES if rules.SEVERITY_RANK[s] >= rules.SEVERITY_RANK[level]]
    return vulns.filter(F.col("severity").isin(wanted))


def check_package(vulns: DataFrame, name: str, version: str | None = None) -> DataFrame:
    found = vulns.filter(F.col("package") == name)
    return found.filter(F.col("version") == version) if version else found


def vuln_summary(vulns: DataFrame, by: Sequence[str] = ("project_id",)) -> DataFrame:
    """Totals by severity and the risk level, per project."""

    def count(level: str) -> Column:
        return F.count_if(F.col("severity") == level).alias(level)

    counts = vulns.groupBy(*by).agg(
        F.count("*").alias("total"), *[count(level) for level in rules.VULN_SEVERITIES]
    )
    return counts.withColumn(
        "risk_level", vulnerability_risk(F.col("critical"), F.col("high"), F.col("moderate"))
    )


def has_critical(vulns: DataFrame, by: Sequence[str] = ("project_id",)) -> DataFrame:
    return vulns.groupBy(*by).agg(
        F.bool_or(F.col("severity").isin("critical", "high")).alias("has_critical")
    )


def security_scores(summary: DataFrame) -> DataFrame:
    """Score and band of every summary row."""
    score = security_score(*[F.col(level) for level in rules.VULN_SEVERITIES])
    return summary.withColumn("score", score).withColumn("band", score_band(F.col("score")))


def group_by_package(vulns: DataFrame, by: Sequence[str] = ("project_id",)) -> DataFrame:
    """Per package the version seen first and how many vulnerabilities it has."""
    first = F.min_by("version", F.struct("seq", "version"))
    return vulns.groupBy(*by, "package").agg(
        F.coalesce(first, F.lit("unknown")).alias("version"),
        F.min("seq").alias("first_seq"),
        F.count("*").alias("vulnerabilities"),
    )


def package_members(
    vulns: DataFrame, by: Sequence[str] = ("project_id",), width: int = 1000
) -> DataFrame:
    """The vulnerabilities of every package as ordered lists, in pages."""
    item = F.struct("version", "severity", "fixed_in", "advisory_id")
    return ordered_pages(vulns, [*by, "package"], "seq", item, width)


def distinct_packages(vulns: DataFrame, by: Sequence[str] = ("project_id",)) -> DataFrame:
    """Each package once per project, with and without a fix, by first appearance."""
    fixable = F.coalesce(F.col("fixed_in") != "", F.lit(False))
    return (
        vulns.withColumn("fixable", fixable)
        .groupBy(*by, "fixable", "package")
        .agg(F.min("seq").alias("first_seq"))
    )


def vuln_recommendations(
    vulns: DataFrame, by: Sequence[str] = ("project_id",), projects: DataFrame | None = None,
    width: int = 1000,
) -> DataFrame:
    """The recommendation sentences of every project, numbered in report order.

    ``projects`` lists the audited projects, so that one without any
    vulnerability gets its sentence too. A sentence that names packages is
    repeated per page of names, see ``ordered_pages``.
    """
    say = rules.VULN_SENTENCES
    rows = vulns.select(*by, "severity")
    if projects is not None:
        rows = rows.unionByName(projects.select(*by, F.lit(None).cast("string").alias("severity")))
    levels = ["critical", "high", "moderate"]
    counts = rows.groupBy(*by).agg(
        F.count("severity").alias("total"),
        *[F.count_if(F.col("severity") == level).alias(level) for level in levels],
    )
    texts = [
        (no, F.when(F.col(level) > 0, say[level])) for no, level in enumerate(levels, start=1)
    ] + [(6, F.when(F.col("total") == 0, say["clean"]))]
    sentences = counts.select(
        *by,
        F.explode(
            F.array(*[F.struct(F.lit(no).alias("rec_no"), text.alias("text")) for no, text in texts])
        ).alias("s"),
    ).select(*by, "s.rec_no", F.lit(0).cast("bigint").alias("page"), "s.text")

    fixable = F.col("fixable")
    names = ordered_pages(
        distinct_packages(vulns, by), [*by, "fixable"], "first_seq", F.col("package"), width
    ).select(
        *by,
        F.when(fixable, 4).otherwise(5).alias("rec_no"),
        "page",
        F.concat(
            F.when(fixable, say["fixable"]).otherwise(say["unfixable"]), F.array_join("items", ", ")
        ).alias("text"),
    )
    return sentences.filter(F.col("text").isNotNull()).unionByName(names)


def latest_within_ttl(
    snapshots: DataFrame, now: Column, ttl_seconds: int = rules.AUDIT_CACHE_SECONDS,
    key: str = "cache_key",
) -> DataFrame:
    """Per key the newest stored audit, if it is younger than the time limit."""
    rest = [c for c in snapshots.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct("fetched_at", "snapshot_id"))
    age = F.timestamp_diff("MICROSECOND", F.col("fetched_at"), now)
    return (
        snapshots.groupBy(key)
        .agg(newest.alias("s"))
        .select(key, "s.*")
        .filter(age < ttl_seconds * 1_000_000)
    )
