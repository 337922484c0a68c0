"""Reports as long tables.

A report row has ``section_no``, ``item`` (order inside the section) and
``line_no`` (order inside the item). Sorting by the three gives the text; no
row number over a whole project is needed. A report reads its input several
times; hand it a stored table where the input is costly to make.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.scoring import score_band
from ..functions.text import explode_once, label_map, number_text
from ..operators.analytics import event_report
from ..operators.issues import vulnerability_title
from ..operators.licenses import (
    incompatible_packages,
    license_audit_recommendations,
    license_audit_summary,
    license_recommendations,
    license_summary,
)
from ..operators.versions import changelog_entries
from ..operators.vulnerabilities import (
    group_by_package,
    security_scores,
    vuln_recommendations,
    vuln_summary,
)

@dataclass(frozen=True)
class Section:
    """The lines one input row adds to one section."""

    no: int
    title: str
    lines: list[Column]
    item: Column = field(default_factory=lambda: F.lit(0))
    part: Column = field(default_factory=lambda: F.lit(0))


def _rows(df: DataFrame, key: str, *sections: Section, parts: bool = False) -> DataFrame:
    """One report row per non-null line of every input row, all sections in one pass; with ``parts``, items have an order inside."""
    lines = [
        F.struct(
            F.lit(s.no).alias("section_no"),
            F.lit(s.title).alias("section"),
            s.item.cast("bigint").alias("item"),
            *([s.part.cast("bigint").alias("part")] if parts else []),
            F.lit(i).alias("line_no"),
            text.alias("text"),
        )
        for s in sections
        for i, text in enumerate(s.lines)
    ]
    kept = F.filter(F.array(*lines), lambda line: line["text"].isNotNull())
    rows = df.select(key, explode_once(kept).alias("line")).filter(F.col("line").isNotNull())
    return rows.select(key, "line.*")


def _bullets(pairs: list[tuple[str, str]]) -> list[Column]:
    return [
        F.concat(F.lit(f"- **{label}:** "), F.col(name).cast("string")) for label, name in pairs
    ]


def _recommendations(recs: DataFrame, no: int, parts: bool = False) -> DataFrame:
    order = F.col("rec_no") * 1_000_000 + F.col("page")
    return _rows(
        recs, "project_id",
        Section(no, "Recommendations", [F.concat(F.lit("- "), F.col("text"))], order), parts=parts,
    )


def vulnerability_report(vulns: DataFrame, report_time: str) -> DataFrame:
    """Heading, summary, score, recommendations, and the vulnerabilities below their packages.

    ``part`` is the order inside an item: below the heading of a package, 0, its vulnerabilities in their order. Title,
    description and cvss are taken from the columns of these names; without them, the texts that an audit without them gives.
    """
    scores = security_scores(vuln_summary(vulns))
    score = F.concat(
        F.lit("**"), F.col("score").cast("string"), F.lit("/100** "), score_band(F.col("score"))
    )
    totals = _rows(
        scores, "project_id",
        Section(0, "Dependency Security Audit Report", [F.lit(f"**Generated:** {report_time}")]),
        Section(1, "Summary", _bullets([
            ("Total Vulnerabilities", "total"), ("Critical", "critical"), ("High", "high"),
            ("Moderate", "moderate"), ("Low", "low"),
        ])),
        Section(2, "Security Score", [score]), parts=True,
    )
    groups = group_by_package(vulns)
    packages = _rows(
        groups, "project_id",
        Section(
            4, "Vulnerabilities by Package",
            [F.concat(F.lit("### "), F.col("package"), F.lit("@"), F.col("version"))],
            F.col("first_seq"),
        ),
        parts=True,
    )
    fixed_in = F.nullif(F.col("fixed_in"), F.lit(""))
    lines = [
        F.concat(F.lit("- **"), F.upper("severity"), F.lit(":** "), vulnerability_title(vulns)),
        F.concat(F.lit("  - "), _given(vulns, "description", F.lit(rules.NO_DESCRIPTION))),
        F.concat(F.lit("  - **Fixed in:** "), fixed_in),
    ]
    if "cvss" in vulns.columns:
        lines.append(F.concat(F.lit("  - **CVSS:** "), number_text(F.col("cvss.score")), F.lit(" ("), F.col("cvss.vector"), F.lit(")")))
    placed = vulns.join(groups.select("project_id", "package", "first_seq"), ["project_id", "package"])
    detail = _rows(
        placed, "project_id",
        Section(4, "Vulnerabilities by Package", lines, F.col("first_seq"), F.col("seq") + 1), parts=True,
    )
    return _union([totals, _recommendations(vuln_recommendations(vulns), 3, parts=True), packages, detail])


def _given(df: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), default) if name in df.columns else default


def license_report(licenses: DataFrame, project_license: str, report_time: str) -> DataFrame:
    """Heading, summary, recommendations and incompatible packages."""
    totals = _rows(
        license_summary(licenses), "project_id",
        Section(0, "License Compliance Report", [
            F.lit(f"**Generated:** {report_time}"),
            F.lit(f"**Project License:** {project_license}"),
        ]),
        Section(1, "Summary", _bullets([
            ("Total Packages", "total"), ("Compatible", "compatible"),
            ("Incompatible", "incompatible"), ("Unknown", "unknown"), ("Total Issues", "issues"),
        ])),
    )
    spdx = F.coalesce(F.nullif(F.col("spdx_id"), F.lit("")), F.lit("Unknown"))
    lines = [
        F.concat(F.lit("### "), F.col("name"), F.lit("@"), F.col("version")),
        F.concat(F.lit("- **License:** "), F.col("license")),
        F.concat(F.lit("- **SPDX ID:** "), spdx),
        F.lit("- **Issues:**"),
    ]
    # a package has at most four issues
    lines += [F.concat(F.lit("  - "), F.get("issues", F.lit(i))) for i in range(4)]
    packages = _rows(
        incompatible_packages(licenses), "project_id",
        Section(3, "Incompatible Packages", lines, F.col("seq")),
    )
    return _union([totals, _recommendations(license_recommendations(licenses), 2), packages])


def license_audit_report(licenses: DataFrame) -> DataFrame:
    """Summary, incompatible and unknown packages, recommendations of the registry audit."""
    summary = license_audit_summary(licenses)

    def point(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"  • {label}: "), value.cast("string"))

    totals = _rows(
        summary, "project_id",
        Section(1, "Summary", [
            point("Total packages", F.col("total")), point("Compatible", F.col("compatible")),
            point("Incompatible", F.col("incompatible")), point("Unknown", F.col("unknown")),
            point("Risk Level", F.upper("risk_level")),
        ]),
    )
    place = F.concat(F.lit("  • "), F.col("name"), F.lit("@"), F.col("version"))
    marked = licenses.join(
        summary.select(
            "project_id",
            (F.col("incompatible") > 0).alias("has_bad"),
            (F.col("unknown") > 0).alias("has_unknown"),
        ),
        "project_id",
    )
    is_bad = F.col("has_bad") & ~F.col("compatible")
    is_unknown = F.col("has_unknown") & (F.col("license") == "unknown")
    issues = [F.concat(F.lit("    - "), F.get("issues", F.lit(i))) for i in range(2)]
    detail = _rows(
        marked, "project_id",
        Section(
            2, "Incompatible Licenses",
            [F.when(is_bad, x) for x in [F.concat(place, F.lit(" - "), F.col("license")), *issues]],
            F.col("seq"),
        ),
        Section(3, "Unknown Licenses", [F.when(is_unknown, place)], F.col("seq")),
    )
    advice = _rows(
        license_audit_recommendations(licenses), "project_id",
        Section(4, "Recommendations", [F.concat(F.lit("  • "), F.col("text"))], F.col("rec_no")),
    )
    return _union([totals, detail, advice])


def changelog_report(commits: DataFrame) -> DataFrame:
    """The entries of a changelog below their section titles, per repository; one pass."""
    order = {name: no for no, name in enumerate(rules.CHANGELOG_SECTIONS, start=1)}
    return changelog_entries(commits).select(
        "repo",
        label_map(order, F.col("section")).alias("section_no"),
        label_map(rules.CHANGELOG_TITLES, F.col("section")).alias("section"),
        F.col("seq").cast("bigint").alias("item"),
        F.lit(0).alias("line_no"),
        F.concat(F.lit("- "), F.col("entry")).alias("text"),
    )


def analytics_report(events: DataFrame, tool: str = rules.TOOL_NAME) -> DataFrame:
    """The event report: one line per type in order of appearance, then the total."""
    lines = event_report(events).withColumn("report", F.lit(f"📊 {tool} Analytics Report"))
    no = F.when(F.col("is_total") == 1, 2).otherwise(1)
    return lines.select(
        "report", no.alias("section_no"), F.when(F.col("is_total") == 0, F.col("first_seq")).alias("item"), "text"
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
