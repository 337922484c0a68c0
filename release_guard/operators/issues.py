"""Tracker issues as rows: search, labels, payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.scoring import audit_priority, license_priority, severity_to_priority
from ..functions.text import label_map, number_text
from .ordering import ordered_pages
from .vulnerabilities import vuln_summary
from .licenses import incompatible_packages, license_summary

BODY_END = "\n---\n*Issue created by "


def search_issues(issues: DataFrame, label: str, limit: int | None = None) -> DataFrame:
    """Issues with a label, highest priority first, newest first; with a limit the first ones."""
    rank = F.coalesce(label_map(rules.PRIORITY_RANK, F.col("priority")), F.lit(0))
    found = issues.filter(F.array_contains("labels", label)).orderBy(
        rank.desc(), F.desc("created_at"), F.desc("issue_id")
    )
    return found if limit is None else found.limit(limit)


def match_labels(requested: DataFrame, labels: DataFrame) -> DataFrame:
    """Ids of requested names, ignoring case; unknown names are left out.

    The same rule serves workflow states and transitions. ``requested`` keeps
    its order in ``pos``; the first entry of ``labels`` wins for a name.
    """
    first = labels.groupBy(F.lower("name").alias("label_key")).agg(
        F.min_by("label_id", "pos").alias("label_id")
    )
    return requested.withColumn("label_key", F.lower("name")).join(first, "label_key").drop("label_key")


def _labels(kind: str, tool: str) -> Column:
    return F.array(*[F.lit(x) for x in [*rules.ISSUE_LABELS[kind], tool]])


def _line(label: str, value: Column) -> Column:
    """``**label:** value`` and a line end, empty when there is no value."""
    filled = value.isNotNull() & (value != "")
    return F.when(filled, F.concat(F.lit(f"**{label}:** "), value, F.lit("\n"))).otherwise("")


def _issue(kind: str, tool: str, keys: Sequence[str], title: Column, body: Column,
           issue_type: str, priority: Column) -> list[Column]:
    return [
        *[F.col(k) for k in keys],
        F.lit(kind).alias("kind"),
        title.alias("title"),
        body.alias("description"),
        F.lit(issue_type).alias("issue_type"),
        priority.alias("priority"),
        _labels(kind, tool).alias("labels"),
    ]


def security_issues(
    problems: DataFrame, keys: Sequence[str], tracker: str, tool: str = rules.TOOL_NAME
) -> DataFrame:
    """One bug per security problem.

    ``problems`` has title, description and severity, and optionally package,
    version, cve, cvss, file, line and recommendation.
    """

    def field(name: str) -> Column:
        return F.col(name).cast("string") if name in problems.columns else F.lit(None).cast("string")

    place = F.when(field("line").isNotNull(), F.concat(field("file"), F.lit(":"), field("line"))).otherwise(
        field("file")
    )
    score = number_text(F.col("cvss")) if "cvss" in problems.columns else field("cvss")
    advice = _line("Recommendation", field("recommendation"))
    body = F.concat(
        F.col("description"),
        F.lit("\n\n"),
        _line("Package", field("package")),
        _line("Version", field("version")),
        _line("CVE", field("cve")),
        _line("CVSS Score", score),
        _line("File", place),
        F.when(advice != "", F.concat(F.lit("\n"), advice)).otherwise(""),
        F.lit(f"{BODY_END}{tool} Security Scanner*"),
    )
    title = F.concat(F.lit("[Security] "), F.col("title"))
    return problems.select(
        *_issue("security", tool, keys, title, body, "Bug",
                severity_to_priority(F.col("severity"), tracker))
    )


def secret_issues(
    findings: DataFrame, tracker: str, by: Sequence[str] = ("project_id",),
    tool: str = rules.TOOL_NAME,
) -> DataFrame:
    """One bug per project in which a scan found secrets."""
    counted = findings.groupBy(*by).agg(F.count("*").alias("n"))
    problems = counted.select(
        *by,
        F.lit("Secrets detected in source code").alias("title"),
        F.concat(
            F.lit("Found "), F.col("n").cast("string"), F.lit(" potential secrets during scan.")
        ).alias("description"),
        F.lit("critical").alias("severity"),
        F.lit("Remove secrets and use environment variables").alias("recommendation"),
    )
    return security_issues(problems, by, tracker, tool)


def dependency_issues(
    vulns: DataFrame, tracker: str, by: Sequence[str] = ("project_id",),
    tool: str = rules.TOOL_NAME,
) -> DataFrame:
    """One task per project with critical or high vulnerabilities."""
    totals = vuln_summary(vulns, by).filter((F.col("critical") > 0) | (F.col("high") > 0))
    summary = F.concat(
        F.col("critical").cast("string"),
        F.lit(" critical and "),
        F.col("high").cast("string"),
        F.lit(" high vulnerabilities found"),
    )
    body = F.concat(summary, F.lit(f"\n{BODY_END}{tool} Dependency Auditor*"))
    return totals.select(
        *_issue(
            "dependency", tool, by, F.concat(F.lit("[Dependency Audit] "), summary), body, "Task",
            audit_priority(F.col("critical") > 0, F.col("high") > 0, tracker),
        )
    )


def vulnerability_title(vulns: DataFrame) -> Column:
    """The title of a vulnerability; where there is none, the one an audit gives it."""
    default = F.concat(F.lit("Vulnerability in "), F.col("package"))
    return F.coalesce(F.nullif(F.col("title"), F.lit("")), default) if "title" in vulns.columns else default


def dependency_issue_lists(
    vulns: DataFrame, by: Sequence[str] = ("project_id",), width: int = 1000
) -> DataFrame:
    """The vulnerability list that goes into a dependency issue, in pages."""
    serious = vulns.filter(F.col("severity").isin("critical", "high"))
    fixed_in = F.nullif(F.col("fixed_in"), F.lit(""))
    item = F.concat(
        F.lit("• "), F.col("package"), F.lit("@"), F.col("version"), F.lit(" - "),
        F.upper("severity"), F.lit(": "), vulnerability_title(vulns), F.lit("\n"),
        F.when(fixed_in.isNotNull(), F.concat(F.lit("  Fixed in: "), fixed_in, F.lit("\n"))).otherwise(""),
    )
    return ordered_pages(serious, by, "seq", item, width).select(
        *by, "page",
        F.concat(F.lit("**Vulnerabilities Found:**\n"), F.array_join("items", "")).alias("text"),
    )


def issue_recommendations(recommendations: DataFrame, issues: DataFrame, by: Sequence[str] = ("project_id",)) -> DataFrame:
    """The recommendations that go into the issues, one bullet per row in the order of ``rec_no`` and ``page``.

    ``recommendations(..., rec_no, page, text)`` of a dependency or licence audit; only of projects with an issue.
    """
    chosen = recommendations.join(issues.select(*by).distinct(), list(by), "left_semi")
    page = F.col("page") if "page" in recommendations.columns else F.lit(0)
    return chosen.select(
        *by, "rec_no", page.cast("long").alias("page"), F.concat(F.lit("• "), F.col("text"), F.lit("\n")).alias("text")
    )


def license_issues(
    licenses: DataFrame, tracker: str, by: Sequence[str] = ("project_id",),
    tool: str = rules.TOOL_NAME,
) -> DataFrame:
    """One task per project with incompatible licences."""
    totals = license_summary(licenses, by).filter(F.col("incompatible") > 0)
    summary = F.concat(
        F.col("incompatible").cast("string"), F.lit(rules.LICENSE_SENTENCES["incompatible"])
    )
    body = F.concat(summary, F.lit(f"\n{BODY_END}{tool} License Checker*"))
    return totals.select(
        *_issue(
            "license", tool, by, F.concat(F.lit("[License Compliance] "), summary), body, "Task",
            license_priority(F.col("incompatible")),
        )
    )


def license_issue_lists(
    licenses: DataFrame, by: Sequence[str] = ("project_id",), width: int = 1000
) -> DataFrame:
    """The package list that goes into a licence issue, in pages."""
    item = F.concat(
        F.lit("• "), F.col("name"), F.lit("@"), F.col("version"),
        F.lit(" ("), F.col("license"), F.lit(")\n"),
        F.array_join(
            F.transform("issues", lambda i: F.concat(F.lit("  - "), i, F.lit("\n"))), ""
        ),
    )
    return ordered_pages(incompatible_packages(licenses), by, "seq", item, width).select(
        *by, "page",
        F.concat(F.lit("**Incompatible Packages:**\n"), F.array_join("items", "")).alias("text"),
    )
