"""Publish gates, warnings, the whole workflow and the overall risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.scoring import overall_risk_level, overall_risk_points
from ..operators.analytics import dependents_count


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("project_id").agg(F.count("*").alias(name))


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _facts(*parts: tuple[DataFrame, dict[str, Column]]) -> DataFrame:
    """One narrow row per fact, all kinds in one table: the project and the figures this fact adds.

    Only these columns enter the shuffle, combined per project before it; a project is known by any of its facts.
    """
    names = list(dict.fromkeys(name for _, figures in parts for name in figures))
    tables = [
        df.select("project_id", *[figures.get(n, F.lit(None)).alias(n) for n in names]) for df, figures in parts
    ]
    whole = tables[0]
    for part in tables[1:]:
        whole = whole.unionByName(part)
    return whole


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("long")


def publish_gate(projects: DataFrame, findings: DataFrame, git: DataFrame, ci: DataFrame) -> DataFrame:
    """May a project be published: every check has to pass.

    ``git(project_id, is_clean)`` and ``ci(project_id, is_passing)`` give the state of the other two checks; a project
    they do not name fails them. Projects are those of ``projects`` and all that any of the facts names.
    """
    facts = _facts(
        (projects, {"secrets": F.lit(0).cast("long")}), (findings, {"secrets": F.lit(1).cast("long")}),
        (git, {"git": F.col("is_clean")}), (ci, {"ci": F.col("is_passing")}),
    )
    checked = facts.groupBy("project_id").agg(
        F.coalesce(F.bool_and("git"), F.lit(False)).alias("git_status"),
        (F.coalesce(F.sum("secrets"), F.lit(0)) == 0).alias("secret_scan"),
        F.coalesce(F.bool_and("ci"), F.lit(False)).alias("ci_status"),
    )
    return checked.withColumn(
        "all_passed", F.col("git_status") & F.col("secret_scan") & F.col("ci_status")
    )


def publish_warnings(
    files: DataFrame, deps: DataFrame, bumps: DataFrame, tokens: DataFrame
) -> DataFrame:
    """Warnings per project: size, number of dependencies, major bump, random strings."""
    size = files.groupBy("project_id").agg(F.sum("size").alias("bytes"))
    joined = (
        size.join(_count(deps, "dependencies"), "project_id", "full_outer")
        .join(bumps.select("project_id", "recommended_bump"), "project_id", "full_outer")
        .join(_count(tokens, "tokens"), "project_id", "full_outer")
    )
    major = F.coalesce(F.col("recommended_bump") == "major", F.lit(False))
    conditions = [
        ("Large package size", _or_zero("bytes") > rules.MAX_PACKAGE_BYTES),
        ("Many dependencies", _or_zero("dependencies") > rules.MAX_DIRECT_DEPENDENCIES),
        ("Breaking changes", major),
        ("High entropy strings", _or_zero("tokens") > 0),
    ]
    return joined.select(
        "project_id",
        F.array_compact(F.array(*[F.when(c, text) for text, c in conditions])).alias("warnings"),
    )


def security_workflow(
    projects: DataFrame, findings: DataFrame, licenses: DataFrame, vulns: DataFrame
) -> DataFrame:
    """Secrets, then licences and vulnerabilities, one row per project of ``projects`` or of any fact.

    Where secrets were found the workflow stops: the later columns are null.
    """
    facts = _facts(
        (projects, {"secrets": F.lit(0).cast("long")}), (findings, {"secrets": F.lit(1).cast("long")}),
        (licenses, {"incompatible": _flag(~F.col("compatible"))}),
        (vulns, {"critical": _flag(F.col("severity") == "critical"), "high": _flag(F.col("severity") == "high")}),
    )
    joined = facts.groupBy("project_id").agg(*[F.sum(c).alias(c) for c in ("secrets", "incompatible", "critical", "high")])
    secrets = _or_zero("secrets")
    later = {c: F.when(secrets == 0, _or_zero(c)) for c in ("incompatible", "critical", "high")}
    issues = (later["incompatible"] > 0) | (later["critical"] > 0) | (later["high"] > 0)
    return joined.select(
        "project_id",
        secrets.alias("secrets"),
        (secrets > 0).alias("stopped"),
        *[c.alias(name) for name, c in later.items()],
        issues.alias("has_issues"),
    )


def unpublish_impact(deps: DataFrame, downloads: DataFrame) -> DataFrame:
    """Downloads and dependents of every package, with a risk level.

    The cut-offs are ours: a package with over 100 dependents or a million
    downloads is critical, over 50 or 100,000 high, any dependents medium.
    """
    loads = downloads.groupBy("name").agg(F.sum("downloads").alias("downloads"))
    joined = loads.join(dependents_count(deps), "name", "full_outer")
    loaded, used = _or_zero("downloads"), _or_zero("dependents")
    risk = (
        F.when((used > 100) | (loaded > 1_000_000), "critical")
        .when((used > 50) | (loaded > 100_000), "high")
        .when(used > 0, "medium")
        .otherwise("low")
    )
    return joined.select(
        "name",
        loaded.alias("downloads"),
        used.alias("dependents"),
        risk.alias("risk_level"),
        F.when(used > 0, "This version has active dependents").alias("warning"),
    )


def overall_risk(
    findings: DataFrame, diff_summary: DataFrame, licenses: DataFrame, vulns: DataFrame
) -> DataFrame:
    """Points and level over secrets, secret changes, licences and vulnerabilities, for every project any of them names."""
    facts = _facts(
        (findings, {"secrets": F.lit(1).cast("long")}), (diff_summary, {"diff_risk": F.col("risk_level")}),
        (licenses, {"incompatible": _flag(~F.col("compatible"))}),
        (vulns, {c: _flag(F.col("severity") == c) for c in ("critical", "high", "moderate")}),
    )
    counts = ("secrets", "incompatible", "critical", "high", "moderate")
    joined = facts.groupBy("project_id").agg(*[F.sum(c).alias(c) for c in counts], F.max("diff_risk").alias("diff_risk"))
    points = overall_risk_points(
        _or_zero("secrets"), F.coalesce("diff_risk", F.lit("low")), _or_zero("incompatible"),
        _or_zero("critical"), _or_zero("high"), _or_zero("moderate"),
    )
    return joined.select("project_id", points.alias("points")).withColumn(
        "risk_level", overall_risk_level(F.col("points"))
    )
