"""What the plans must look like on stored tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from release_guard import catalog
from release_guard.catalog import issues, reports
from release_guard.operators import analytics, deployments, licenses, monitoring, secrets, vulnerabilities
from release_guard.plans import audits
from release_guard.plans.scan import run_publish, secret_scan
from release_guard.sources import manifests

DAY = dt.datetime(2024, 1, 1)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, rows, tmp_path):
    def store(schema, *data):
        path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        rows(schema, *data).write.parquet(path)
        return spark.read.parquet(path)

    return store


VULN = "project_id bigint, seq bigint, package string, version string, severity string, fixed_in string"


def test_filters_reach_the_scan(stored):
    vulns = stored(VULN, (1, 1, "a", "1", "high", None))
    for frame, pushed in [
        (vulnerabilities.filter_audit_level(vulns, "high"), "In(severity"),
        (vulnerabilities.filter_vulns_by_severity(vulns, "low"), "EqualTo(severity,low)"),
        (vulnerabilities.check_package(vulns, "a", "1"), "EqualTo(package,a)"),
        (analytics.filter_logs(stored("seq bigint, level string", (1, "warn")), "warn"), "In(level"),
        (licenses.production_only(stored("name string, dep_scope string", ("a", "prod"))), "EqualTo(dep_scope,prod)"),
        (deployments.deployments_query(stored("seq bigint, environment string, created_at timestamp_ntz", (1, "x", DAY)), "x", limit=3),
         "EqualTo(environment,x)"),
    ]:
        assert pushed in plan(frame)


def test_retention_reaches_the_scan(stored):
    metrics = stored("seq bigint, ts timestamp", (1, DAY))
    recent = monitoring.retain_recent(metrics, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    assert "GreaterThan(ts" in plan(recent)


def test_summaries_read_two_columns(stored):
    summary = vulnerabilities.vuln_summary(stored(VULN, (1, 1, "a", "1", "high", None)))
    assert "ReadSchema: struct<project_id:bigint,severity:string>" in plan(summary)


def test_top_per_group_is_cut_before_the_shuffle(stored):
    logs = stored("deployment_id bigint, seq bigint, ts timestamp_ntz, level string, message string", (1, 1, DAY, "error", "m"))
    for frame in (deployments.last_logs(logs, 3), deployments.first_errors(logs, 3)):
        text = plan(frame)
        assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_scan_has_no_shuffle_and_tests_before_it_matches(stored):
    text = plan(secret_scan(stored("file string, content string", ("a", "b"))))
    assert "Exchange" not in text
    # A test of whole files, then one of lines with the matches of those that pass.
    assert text.count("ArrowEvalPython") == 1 and text.count("MapInArrow") == 1
    assert text.index("MapInArrow") < text.index("posexplode") < text.index("ArrowEvalPython")


def test_summary_of_a_hot_severity_combines_before_the_shuffle(stored):
    findings = stored("file string, severity string", *[(f"f{i % 3}", "high") for i in range(50)])
    found = secrets.severity_rollup(findings)
    assert [tuple(r) for r in found.collect()] == [("high", 50, 3)]
    assert plan(found).count("partial_") >= 2


def test_publish_hooks(rows):
    packages = rows("project_id bigint, size bigint", (1, 10), (2, 99))
    out = run_publish(packages, lambda p: p.withColumn("passed", F.col("size") < 50), lambda p: p.withColumn("sent", F.lit(True)))
    assert [tuple(r) for r in out.collect()] == [(1, 10, True)]


@pytest.mark.parametrize("name", ["audit_report", "dependency_audit_recommendations", "audit_issue_lists"])
def test_audit_documents_are_parsed_by_many_tasks_though_one_row_group_holds_them(spark, rows, tmp_path, monkeypatch, name):
    schema = "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_returnflag string"
    rows(schema, *[(i, i % 7, 1, "R") for i in range(400)]).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    rows("s_suppkey bigint", (1,)).write.parquet(str(tmp_path / "supplier.parquet"))
    parsed = []
    parse = manifests.parse_audit_json
    for module in (reports, audits, issues):
        monkeypatch.setattr(module, "parse_audit_json", lambda docs, *a: (parsed.append(docs), parse(docs, *a))[1])
    catalog.queries()[name](spark, str(tmp_path))
    (docs,) = parsed
    assert docs.count() == 400
    assert docs.select(F.spark_partition_id().alias("p")).distinct().count() > spark.sparkContext.defaultParallelism
