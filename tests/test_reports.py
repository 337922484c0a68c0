"""Report and issue texts, gates over all projects, manifest order, the cap: hand-made cases."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from release_guard import rules
from release_guard.operators import issues, monitoring, vulnerabilities
from release_guard.plans import gates, reports
from release_guard.sources.manifests import explode_manifest, parse_audit_json

DOC = """{"vulnerabilities": {
 "left": {"id": "A-1", "title": "Overflow", "description": "Reads too far", "severity": "high", "version": "1.2.0", "fixedIn": "1.2.1",
  "cvss": {"score": 9, "vector": "AV:N"}},
 "right": {"severity": "moderate", "version": "2.0.0", "fixedIn": ""}}}"""


def test_report_text(rows):
    vulns = parse_audit_json(rows("project_id bigint, audit_json string", (1, DOC)), "T")
    more = vulns.where("package = 'left'").withColumn("seq", F.lit(5).cast("long")).withColumn("title", F.lit("Second"))
    report = reports.vulnerability_report(vulns.unionByName(more), "now").where("section_no = 4")
    text = [r["text"] for r in report.orderBy("section_no", "item", "part", "line_no").collect()]
    assert text == [
        "### left@1.2.0",
        "- **HIGH:** Overflow", "  - Reads too far", "  - **Fixed in:** 1.2.1", "  - **CVSS:** 9 (AV:N)",
        "- **HIGH:** Second", "  - Reads too far", "  - **Fixed in:** 1.2.1", "  - **CVSS:** 9 (AV:N)",
        "### right@2.0.0",
        "- **MODERATE:** Vulnerability in right", f"  - {rules.NO_DESCRIPTION}",
    ]


def test_issue_text(rows):
    vulns = parse_audit_json(rows("project_id bigint, audit_json string", (1, DOC.replace('"moderate"', '"critical"'))), "T")
    (page,) = issues.dependency_issue_lists(vulns).collect()
    assert page["text"] == (
        "**Vulnerabilities Found:**\n• left@1.2.0 - HIGH: Overflow\n  Fixed in: 1.2.1\n• right@2.0.0 - CRITICAL: Vulnerability in right\n"
    )
    advice = issues.issue_recommendations(vulnerabilities.vuln_recommendations(vulns), issues.dependency_issues(vulns, "linear"))
    assert all(r["text"].startswith("• ") and r["text"].endswith("\n") for r in advice.collect()) and advice.count() >= 2
    assert issues.issue_recommendations(vulnerabilities.vuln_recommendations(vulns), issues.dependency_issues(vulns.limit(0), "linear")).count() == 0


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_gate_knows_all_projects(rows):
    projects = rows("project_id bigint", (1,), (2,))
    findings = rows("project_id bigint, file string", (0, "a"), (10**12, "b"), (1, "c"), (None, "d"))
    git = rows("project_id bigint, is_clean boolean", (2, True), (3, True), (3, False))
    ci = rows("project_id bigint, is_passing boolean", (2, True), (4, True), (1, True))
    gate = gates.publish_gate(projects, findings, git, ci)
    assert plan(gate).count("Exchange hashpartitioning") == 1 and "Join" not in plan(gate)
    found = {r["project_id"]: tuple(r)[1:] for r in gate.collect()}
    assert found == {
        0: (False, False, False, False), 10**12: (False, False, False, False), None: (False, False, False, False),
        1: (False, False, True, False), 2: (True, True, True, True), 3: (False, True, False, False), 4: (False, True, True, False),
    }


def test_workflow_and_risk_know_all_projects(rows):
    findings = rows("project_id bigint, file string", (0, "a"))
    licenses = rows("project_id bigint, compatible boolean", (0, False), (5, False), (5, True), (6, True), (7, None))
    vulns = rows("project_id bigint, severity string", (0, "critical"), (10**12, "critical"), (6, "high"), (8, "low"), (9, None))
    flow = gates.security_workflow(rows("project_id bigint", (1,)), findings, licenses, vulns)
    assert plan(flow).count("Exchange hashpartitioning") == 1
    found = {r["project_id"]: tuple(r)[1:] for r in flow.collect()}
    assert found == {
        0: (1, True, None, None, None, None), 1: (0, False, 0, 0, 0, False), 5: (0, False, 1, 0, 0, True), 6: (0, False, 0, 0, 1, True),
        7: (0, False, 0, 0, 0, False), 8: (0, False, 0, 0, 0, False), 9: (0, False, 0, 0, 0, False), 10**12: (0, False, 0, 1, 0, True),
    }
    diff = rows("project_id bigint, risk_level string", (11, "critical"), (0, "high"))
    risk = {r["project_id"]: r["points"] for r in gates.overall_risk(findings, diff, licenses, vulns).collect()}
    assert risk == {0: 3 + 2 + 1 + 3, 5: 1, 6: 2, 7: 0, 8: 0, 9: 0, 10**12: 3, 11: 3}


def test_dev_version_in_the_place_of_prod(rows):
    doc = '{"dependencies": {"b": "1", "a": "2", "c": "3"}, "devDependencies": {"z": "4", "a": "5", "y": "6"}}'
    manifest = rows("id int, manifest_json string", (1, doc), (2, '{"devDependencies": {"q": "1"}}'), (3, "{}"), (4, None))
    found = [tuple(r) for r in explode_manifest(manifest, include_dev=True).orderBy("id", "seq").collect()]
    assert found == [
        (1, 0, "b", "1", "prod"), (1, 1, "a", "5", "dev"), (1, 2, "c", "3", "prod"), (1, 3, "z", "4", "dev"), (1, 4, "y", "6", "dev"),
        (2, 0, "q", "1", "dev"),
    ]


def test_cap_needs_no_window_over_the_history(rows):
    start = dt.datetime(2021, 12, 31, 23, 58)
    times = [start + dt.timedelta(minutes=i // 3) for i in range(30)] + [start - dt.timedelta(days=400)] * 3 + [None]
    metrics = rows("seq bigint, ts timestamp_ntz", *enumerate(times))
    order = sorted(range(len(times)), key=lambda i: (times[i] is not None, times[i] or start, i), reverse=True)
    for n in (1, 5, 6, 7, 29, 30, 31, 33, 34, 99):
        kept = monitoring.cap_rows(metrics, n)
        assert [r["seq"] for r in kept.collect()] == order[:n], n
    assert "Window" not in plan(kept) and monitoring.cap_rows(metrics, 0).count() == 0
