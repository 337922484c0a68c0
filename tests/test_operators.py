"""Hand-made cases for the operators."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from release_guard.operators import (
    analytics, deployments, issues, licenses, monitoring, ordering, secrets, test_runs, versions,
    vulnerabilities,
)
from release_guard.plans import audits
from release_guard.plans.scan import secret_scan
from release_guard.rules import SecretPattern

DAY = dt.datetime(2024, 1, 1)


def at(minutes):
    return DAY + dt.timedelta(minutes=minutes)


def tuples(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


FILES = "file string, content string"
KEY = "AKIA" + "ABCDEFGHIJ012345"


def test_scan_positions_and_context(rows):
    content = f"first line\r\nid={KEY} and {KEY}\nlast"
    found = secret_scan(rows(FILES, ("a.env", content)))
    assert tuples(found, "line", "column", "pattern_name") == [
        (2, 4, "AWS Access Key"), (2, 29, "AWS Access Key")]
    assert {r["context"] for r in found.collect()} == {f"id={KEY} and {KEY}"}


def test_scan_of_empty_and_missing_text(rows):
    assert secret_scan(rows(FILES, ("a", ""), ("b", None))).count() == 0


def test_line_anchor_sees_every_line(rows):
    """A pattern tied to the line start must not be lost on later lines of a file."""
    pattern = SecretPattern("Start", r"^pw \d{4}$", "low", entropy=0.0)
    found = secret_scan(rows(FILES, ("a", "x\npw 1234\ny"), ("b", "no pw 1234")), [pattern])
    assert tuples(found, "file", "line", "column") == [("a", 2, 1)]


def test_token_inside_named_hit_is_not_reported_twice(rows):
    found = secret_scan(rows(FILES, ("a", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"')))
    assert tuples(found, "pattern_name") == [("Generic Secret Assignment",)]


def test_low_entropy_token_is_dropped(rows):
    found = secret_scan(rows(FILES, ("a", "a" * 40), ("b", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")))
    assert tuples(found, "file", "pattern_name") == [("b", "High Entropy String")]


def test_allow_list(rows):
    found = secret_scan(rows(FILES, ("a", KEY)), allowed=rows("value string", (KEY,)))
    assert found.count() == 0


def test_scan_equals_scan_without_prefilter(rows, monkeypatch):
    texts = [f"{'x' * (i % 25)} {KEY[: i % 21]} password='{'ab1' * (i % 5)}' {'Zz9+' * (i % 9)}" for i in range(200)]
    files = rows(FILES, *[(f"f{i}", t) for i, t in enumerate(texts)])
    columns = ["file", "line", "column", "pattern_name", "value", "entropy"]
    filtered = tuples(secret_scan(files), *columns)
    monkeypatch.setattr(secrets, "may_match", lambda text, regexes: text.isNotNull())
    assert filtered == tuples(secret_scan(files), *columns)
    assert filtered


FINDING = "file string, line int, column int, pattern_name string, severity string, value string"


def test_diff(rows):
    before = rows(FINDING, ("a", 1, 1, "p", "high", "v"), ("b", 1, 1, "p", "high", "old"), ("c", 1, 1, "p", "high", "v"))
    now = rows(FINDING, ("a", 1, 1, "p", "high", "v"), ("b", 1, 1, "p", "high", "new"),
               ("c", 2, 1, "p", "high", "v"), ("d", 1, 1, "p", "critical", "v"), ("d", 1, 9, "p", "critical", "v"))
    changes = secrets.secret_diff(now, before)
    assert tuples(changes, "file", "line", "column", "change") == [
        ("a", 1, 1, "unchanged"), ("b", 1, 1, "modified"), ("c", 1, 1, "removed"), ("c", 2, 1, "added"),
        ("d", 1, 1, "added"), ("d", 1, 9, "added")]
    summary = secrets.secret_diff_summary(changes).collect()[0]
    assert tuple(summary) == (3, 1, 1, 1, "critical")


def test_one_path_in_two_projects(rows):
    schema = "project_id bigint, " + FINDING
    now = rows(schema, (1, "a.js", 1, 1, "p", "high", "v"), (2, "a.js", 1, 1, "p", "high", "v"), (None, "a.js", 1, 1, "p", "high", "v"))
    before = rows(schema, (1, "a.js", 1, 1, "p", "high", "v"), (3, "a.js", 1, 1, "p", "high", "v"), (None, "a.js", 1, 1, "p", "high", "v"))
    changes = secrets.secret_diff(now, before).fillna(0, "project_id")
    assert tuples(changes, "project_id", "change") == [(0, "unchanged"), (1, "unchanged"), (2, "added"), (3, "removed")]
    assert tuples(secrets.added_findings(now, before), "project_id") == [(2,)]
    assert tuples(secrets.removed_findings(now, before), "project_id") == [(3,)]
    files = rows("project_id bigint, file string, content string", (1, "a.js", "x"), (4, "a.js", "x"), (4, "b.js", "x"))
    assert tuples(secrets.clean_files(files, now), "project_id", "file") == [(4, "a.js"), (4, "b.js")]
    assert tuples(secrets.severity_rollup(now), "severity", "findings", "files") == [("high", 3, 3)]
    assert tuples(secrets.severity_rollup(now.where("project_id = 1"), ["project_id"]), "project_id", "files") == [(1, 1)]


@pytest.mark.parametrize("severity,risk", [("critical", "critical"), ("high", "high"), ("low", "medium")])
def test_diff_risk(rows, severity, risk):
    now = rows(FINDING, ("a", 1, 1, "p", severity, "v"))
    none = rows(FINDING)
    assert secrets.secret_diff_summary(secrets.secret_diff(now, none)).collect()[0]["risk_level"] == risk
    assert secrets.secret_diff_summary(secrets.secret_diff(none, now)).collect()[0]["risk_level"] == "low"


COMMITS = "repo string, seq bigint, subject string"


def test_bumps(rows):
    commits = rows(COMMITS, ("a", 1, "fix: x"), ("a", 2, "feat!: y"), ("b", 1, "perf: z"), ("c", 1, "feat: n"), ("d", 1, "fix: n"))
    current = rows("repo string, version string", ("a", "1.2.3"), ("b", "1.0.0"), ("c", "0.9.9"), ("d", "1.2.3-rc"), ("e", "3.0.0"))
    found = audits.version_analysis(commits, current)
    assert tuples(found, "repo", "recommended_bump", "new_version", "confidence") == [
        ("a", "major", "2.0.0", 80), ("b", "none", "1.0.0", 20), ("c", "minor", "0.10.0", 65),
        ("d", "patch", "1.2.1", 60), ("e", "none", "3.0.0", 20)]


def test_breaking_feature_is_listed_once(rows):
    found = versions.version_reasons(rows(COMMITS, ("a", 1, "feat!: y"), ("a", 2, "feat: z")))
    assert tuples(found, "seq", "list") == [(1, "breaking"), (2, "features")]


def test_pages_hold_the_whole_list_in_order(rows):
    df = rows("k string, seq bigint, v string", *[("hot", i, f"v{i}") for i in range(95)], ("cold", 7, "x"))
    pages = ordering.ordered_pages(df, ["k"], "seq", F.col("v"), width=10)
    hot = [r for r in pages.orderBy("page").collect() if r["k"] == "hot"]
    assert max(len(r["items"]) for r in pages.collect()) == 10
    assert [v for r in hot for v in r["items"]] == [f"v{i}" for i in range(95)]


def test_version_order(rows):
    df = rows("version string", ("1.10.0",), ("1.9.9",), ("1.9.10",), ("0.1",))
    assert [r[0] for r in ordering.sort_versions(df).collect()] == ["0.1", "1.9.9", "1.9.10", "1.10.0"]


VULN = "project_id bigint, seq bigint, package string, version string, severity string, fixed_in string, advisory_id bigint"


def test_vulnerability_sentences(rows):
    vulns = rows(VULN, (1, 1, "a", "1", "critical", "2", 1), (1, 2, "b", "1", "low", None, 2), (1, 3, "a", "1", "low", "", 3))
    recs = vulnerabilities.vuln_recommendations(vulns, projects=rows("project_id bigint", (1,), (2,), (2,)))
    found = [(r["project_id"], r["rec_no"], r["text"].split(": ")[-1]) for r in recs.orderBy("project_id", "rec_no").collect()]
    assert [f[:2] for f in found] == [(1, 1), (1, 4), (1, 5), (2, 6)]
    assert found[1][2] == "a" and found[2][2] == "b, a"


def test_first_seen_version(rows):
    vulns = rows(VULN, (1, 2, "a", "2", "low", None, 1), (1, 1, "a", "1", "low", None, 2), (1, 1, "b", None, "low", None, 2))
    assert tuples(vulnerabilities.group_by_package(vulns), "package", "version", "vulnerabilities") == [
        ("a", "1", 2), ("b", "unknown", 1)]


def test_cache_expires(rows):
    snaps = rows("cache_key string, snapshot_id bigint, fetched_at timestamp_ntz",
                 ("a", 1, at(0)), ("a", 2, at(30)), ("b", 3, at(0)))
    now = F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")
    assert tuples(vulnerabilities.latest_within_ttl(snaps, now), "cache_key", "snapshot_id") == [("a", 2)]


MANIFEST = "project_id bigint, seq bigint, name string, version_range string, dep_scope string"
INSTALLED = "name string, license string"


def test_dev_wins_and_missing_packages_go(rows):
    manifest = rows(MANIFEST, (1, 0, "a", "^1", "prod"), (1, 1, "a", "^2", "dev"), (1, 2, "gone", "^1", "prod"))
    installed = rows(INSTALLED, ("a", ""))
    assert tuples(licenses.resolve_licenses(manifest, installed, True), "name", "version", "license") == [("a", "^2", "UNKNOWN")]
    assert tuples(licenses.resolve_licenses(manifest, installed), "name", "version") == [("a", "^1")]


def test_license_issue_order_and_raw_lists(rows):
    packages = rows("project_id bigint, seq bigint, name string, version string, license string",
                    (1, 1, "a", "1", "GPLv3"), (1, 2, "b", "1", "GPL-3.0"), (1, 3, "c", "1", "undefined"), (1, 4, "d", "1", "MIT"))
    found = licenses.analyze_license(packages, allowed=["MIT"], blocked=["GPL-3.0"], project_license="MIT")
    issues_of = {r["name"]: r["issues"] for r in found.collect()}
    assert [i.split()[-1] for i in issues_of["a"]] == ["list", '"MIT"']
    assert [i.split()[2] for i in issues_of["b"]] == ["is", "is", "is"] and "blocked" in issues_of["b"][0]
    assert issues_of["c"][-1] == "License information is missing or unknown" and len(issues_of["c"]) == 3
    assert issues_of["d"] == []


@pytest.mark.parametrize("mode,gpl,limited", [("reference", True, True), ("normalized", False, True)])
def test_registry_audit_modes(rows, mode, gpl, limited):
    deps = rows(MANIFEST.replace(", dep_scope string", ""), (1, 1, "g", "1"), (1, 2, "l", "1"), (1, 3, "none", "1"), (1, 4, "e", "1"))
    registry = rows(INSTALLED, ("g", "GPL-3.0"), ("l", "LIMITED"), ("e", ""))
    found = {r["name"]: r for r in licenses.audit_licenses(deps, registry, mode=mode).collect()}
    assert found["g"]["compatible"] is gpl
    assert found["l"]["compatible"] is limited and found["l"]["issues"] == []
    assert found["none"]["license"] == "unknown" and not found["none"]["compatible"]
    assert found["e"]["license"] == "unknown" and found["e"]["compatible"]


def test_registry_audit_counts_unknown_apart(rows):
    deps = rows(MANIFEST.replace(", dep_scope string", ""), (1, 1, "x", "1"))
    audited = licenses.audit_licenses(deps, rows(INSTALLED))
    assert tuples(licenses.license_audit_summary(audited), "incompatible", "unknown") == [(0, 1)]
    texts = [r["text"] for r in licenses.license_audit_recommendations(audited).collect()]
    assert any("1 packages with incompatible" in t for t in texts)


METRIC = "seq bigint, ts timestamp_ntz, type string, value double, unit string, source string"


def test_thresholds(spark, rows):
    metrics = rows(METRIC, (1, at(0), "cpu", 80.0, "%", "h"), (2, at(0), "cpu", 80.5, "%", "h"), (3, at(0), "cpu", 120.0, "%", "h"),
                   (4, at(0), "cpu", 121.0, "%", "h"), (5, at(0), "zero", 9.0, "", "h"), (6, at(0), "custom", 9.0, "", "h"))
    found = monitoring.threshold_join(metrics, monitoring.threshold_table(spark, {"cpu": 80.0, "zero": 0.0}))
    assert tuples(found, "alert_id", "severity", "message") == [
        (2, "warning", "CPU usage is high: 80.5%"), (3, "warning", "CPU usage is high: 120%"),
        (4, "critical", "CPU usage is high: 121%")]


def test_alert_actions(rows):
    alerts = rows("alert_id bigint", (1,), (2,))
    actions = rows("alert_id bigint, action string, actor string, ts timestamp_ntz, seq bigint",
                   (1, "acknowledge", "a", at(1), 1), (1, "acknowledge", "b", at(2), 2), (2, "resolve", "c", at(1), 3), (9, "resolve", "c", at(1), 4))
    assert tuples(monitoring.alert_state(alerts, actions), "alert_id", "acknowledged", "acknowledged_by", "resolved") == [
        (1, True, "b", False), (2, False, None, True)]


def test_retention_is_strict(rows):
    metrics = rows(METRIC, (1, at(0), "cpu", 1.0, "", "h"), (2, at(1), "cpu", 1.0, "", "h"))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    assert tuples(monitoring.retain_recent(metrics, now), "seq") == [(2,)]


@pytest.mark.parametrize("n", [1, 7, 20, 100])
def test_cap(rows, n):
    metrics = rows(METRIC, *[(i, at(i // 3), "cpu", 1.0, "", "h") for i in range(20)])
    assert tuples(monitoring.cap_rows(metrics, n), "seq") == [(i,) for i in range(max(0, 20 - n), 20)]


def test_performance_state_matches_brute_force(rows):
    schema = "source string, seq bigint, ts timestamp_ntz, response_time double, throughput double, error_rate double, availability double"
    data = [("h", i, at(i * 17), *[float(i) if (i + j) % 4 == 0 else None for j in range(4)]) for i in range(60)]
    state, expected = [0.0, 0.0, 0.0, 100.0], []
    for row in data:
        state = [s if v is None else v for s, v in zip(state, row[3:])]
        expected.append((row[1], *state))
    updates = rows(schema, *data)
    columns = ["response_time", "throughput", "error_rate", "availability"]
    assert tuples(monitoring.performance_state(updates), "seq", *columns) == expected
    assert tuples(monitoring.performance_now(updates), *columns) == [expected[-1][1:]]


DEPLOYMENT = "seq bigint, environment string, version string, status string, completed_at timestamp_ntz"


def test_rollback_needs_two_successes(rows):
    df = rows(DEPLOYMENT, (1, "one", "1", "success", at(1)), (2, "two", "1", "success", at(1)), (3, "two", "2", "success", at(1)),
              (4, "two", "3", "failed", at(9)), (5, "none", "1", "failed", at(1)))
    assert tuples(deployments.rollback_target(df), "environment", "version") == [("two", "1")]


REQUEST = "deployment_id bigint, environment string, auto_approve boolean, strategy string"
ACTION = "deployment_id bigint, approver string, action string, ts timestamp_ntz, seq bigint"


def test_approvals(spark, rows):
    requests = rows(REQUEST, (1, "production", False, None), (2, "production", False, ""), (3, "staging", False, "canary"),
                    (4, "development", False, None), (5, "production", True, None), (6, "staging", False, None),
                    (7, "qa", True, None), (8, "staging", True, "big-bang"), (9, "qa", False, None), (10, "staging", False, None))
    actions = rows(ACTION, (1, "dev-lead", "approve", at(1), 1), (1, "ops-lead", "approve", at(2), 2), (2, "dev-lead", "approve", at(1), 3),
                   (3, "dev-lead", "reject", at(1), 4), (3, "dev-lead", "approve", at(2), 5), (6, "visitor", "approve", at(1), 6),
                   (9, "dev-lead", "reject", at(1), 7), (10, "visitor", "reject", at(1), 8), (10, "dev-lead", "approve", at(0), 9))
    state = deployments.deployment_state(requests, deployments.environment_table(spark), actions)
    assert tuples(state, "deployment_id", "status") == [
        (1, "approved"), (2, "pending"), (3, "cancelled"), (4, "approved"), (5, "approved"), (6, "pending"),
        (7, "invalid"), (8, "invalid"), (9, "invalid"), (10, "cancelled")]
    errors = dict(tuples(state, "deployment_id", "error"))
    assert errors[7] == "Environment 'qa' not found" and errors[8] == "Deployment strategy 'big-bang' not found"
    assert errors[1] is None and dict(tuples(state, "deployment_id", "open_approvals")) == {
        1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 1, 7: 0, 8: 0, 9: 0, 10: 0}


def test_state_needs_all_approvers_of_the_given_environments(spark, rows):
    own = rows("name string, auto_approve boolean, deployment_strategy string, required_approvers array<string>",
               ("lab", False, "rolling", ["ann", "bob"]), ("free", False, "rolling", None))
    requests = rows(REQUEST, (1, "lab", False, None), (2, "lab", False, None), (3, "free", False, None))
    actions = rows(ACTION, (1, "ann", "approve", at(1), 1), (1, "bob", "approve", at(2), 2), (2, "ann", "approve", at(1), 3))
    state = deployments.deployment_state(requests, own, actions)
    assert tuples(state, "deployment_id", "status") == [(1, "approved"), (2, "pending"), (3, "approved")]


def test_diff_takes_todays_severity(rows):
    now, before = rows(FINDING, ("a", 1, 1, "p", "critical", "v")), rows(FINDING, ("a", 1, 1, "p", "medium", "w"), ("b", 1, 1, "p", "low", "w"))
    assert tuples(secrets.secret_diff(now, before), "file", "severity") == [("a", "critical"), ("b", "low")]


def test_no_number_raises_no_alert(spark, rows):
    metrics = rows("seq bigint, ts timestamp_ntz, source string, type string, value double, unit string",
                   (1, at(1), "h", "cpu", float("nan"), "%"), (2, at(1), "h", "cpu", 1e27, "%"), (3, at(1), "h", "cpu", 80.1234567890123, "%"))
    alerts = monitoring.threshold_join(metrics, monitoring.threshold_table(spark))
    assert tuples(alerts, "alert_id", "message") == [(2, "CPU usage is high: 1e+27%"), (3, "CPU usage is high: 80.1234567890123%")]


def test_queries_without_a_limit_lose_nothing(rows):
    metrics = rows("seq bigint, type string", *[(i, "cpu") for i in range(150)])
    assert monitoring.metrics_query(metrics, "cpu").count() == 150 and monitoring.metrics_query(metrics, "cpu", 100).count() == 100


def test_unknown_names_are_errors(spark, rows):
    requests = rows("environment string, strategy string", ("qa", None), ("staging", "odd"), ("staging", None))
    found = deployments.validate_requests(requests, deployments.environment_table(spark), deployments.strategy_table(spark))
    assert sorted(str(r["error"]) for r in found.collect()) == [
        "Deployment strategy 'odd' not found", "Environment 'qa' not found", "None"]


def test_first_errors_and_last_logs(rows):
    logs = rows("deployment_id bigint, seq bigint, ts timestamp_ntz, level string, message string",
                *[(1, i, at(i), "error", f"e{i}") for i in range(5)], (2, 9, at(0), "error", "only"), (3, 1, at(0), "info", "i"))
    assert tuples(deployments.first_errors(logs, 3), "deployment_id", "errors") == [(1, "e0\ne1\ne2\n..."), (2, "only")]
    assert tuples(deployments.last_logs(logs, 3), "deployment_id", "recent") == [(1, "e2\ne3\ne4"), (2, "only"), (3, "i")]


def test_silent_lets_nothing_through(rows):
    logs = rows("seq bigint, level string", (1, "error"), (2, "debug"), (3, "silent"))
    assert analytics.filter_logs(logs, "silent").count() == 0
    assert tuples(analytics.filter_logs(logs, "debug"), "seq") == [(1,), (2,)]


def test_suite_matrix_filters(rows):
    runs = rows("run_id bigint", (1,))
    found = test_runs.suite_matrix(runs, only_frameworks=["jest"])
    assert tuples(found, "name") == [("jest-docker",), ("jest-local",)]
    with pytest.raises(ValueError):
        test_runs.suite_matrix(runs, only_frameworks=["none"])


def test_labels_ignore_case_and_take_the_first(rows):
    labels = rows("label_id string, pos int, name string", ("l2", 2, "BUG"), ("l1", 1, "Bug"), ("l3", 3, "Other"))
    wanted = rows("issue_id bigint, pos int, name string", (1, 0, "bug"), (1, 1, "missing"))
    assert tuples(issues.match_labels(wanted, labels), "issue_id", "label_id") == [(1, "l1")]


def test_empty_history_counts(rows):
    events = rows("seq bigint, type string, ts timestamp_ntz, details string")
    stats = analytics.dashboard_stats(events).collect()[0].asDict()
    assert stats["total_scans"] == 0 and stats["total_secrets_found"] == 0 and stats["last_scan"] == "Never"
