"""Version analysis, dependency audit and licence compliance as whole jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import licenses as lic
from ..operators import versions as ver
from ..operators import vulnerabilities as vul
from ..sources.manifests import parse_audit_json


def version_analysis(commits: DataFrame, current: DataFrame) -> DataFrame:
    """Bump, new version and confidence of every repository of ``current(repo, version)``.

    The reasons are rows of their own, see ``version_reasons``. A repository
    without commits keeps its version.
    """
    bumps = ver.version_bump(commits)
    counts = ["n_breaking", "n_features", "n_fixes", "n_commits"]
    joined = current.join(bumps, "repo", "left")
    filled = joined.withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in counts}
        | {"recommended_bump": F.coalesce("recommended_bump", F.lit("none"))}
    )
    return ver.with_next_version(filled, F.col("version"))


def dependency_audit(docs: DataFrame, audit_time: str) -> dict[str, DataFrame]:
    """All tables of a dependency audit from ``docs(project_id, audit_json)``.

    There is one document per project; ``latest_within_ttl`` picks it where
    several are stored.
    """
    vulns = parse_audit_json(docs, audit_time)
    summary = vul.security_scores(vul.vuln_summary(vulns))
    return {
        "vulnerabilities": vulns,
        "summary": summary,
        "recommendations": vul.vuln_recommendations(vulns, projects=docs.select("project_id")),
        "packages": vul.group_by_package(vulns),
    }


def license_compliance(
    manifest: DataFrame,
    installed: DataFrame,
    allowed: Sequence[str] = (),
    blocked: Sequence[str] = (),
    project_license: Column | str = "UNKNOWN",
    include_dev: bool = False,
) -> dict[str, DataFrame]:
    """All tables of a licence compliance check."""
    packages = lic.analyze_license(
        lic.resolve_licenses(manifest, installed, include_dev), allowed, blocked, project_license
    )
    return {
        "packages": packages,
        "summary": lic.license_summary(packages),
        "recommendations": lic.license_recommendations(packages),
    }
