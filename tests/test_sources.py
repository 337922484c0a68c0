"""Readers, writers and streams on small folders."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from release_guard.operators import deployments, monitoring
from release_guard.session import scratch_dir
from release_guard.sources import files, history, manifests
from release_guard.streaming import jobs, state

DAY = dt.datetime(2024, 1, 1)


def tuples(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_read_files_from_folder(spark, tmp_path):
    for name, content in {
        "src/a.ts": b"one", "src/deep/b c.ts": b"two\nlines", "node_modules/x.ts": b"no", "big.ts": b"x" * 100,
        "src/bad.ts": b"ab\xffcd", "plus+sign.ts": b"p",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    found = files.read_files(spark, str(tmp_path), ["**/*.ts"], max_size=50)
    assert tuples(found, "file", "content", "size") == [
        ("plus+sign.ts", "p", 1), ("src/a.ts", "one", 3), ("src/bad.ts", "ab�cd", 5), ("src/deep/b c.ts", "two\nlines", 9)]


def test_read_files_from_table(rows):
    table = rows("file string, content string", ("a.ts", "é"), ("node_modules/a.ts", "x"))
    assert tuples(files.read_files(None, table), "file", "size") == [("a.ts", 2)]


def test_git_log(rows):
    lines = rows("line string", ("h|fix: x|me|2024-01-01|HEAD",), ("h|a | b|me|2024-01-01|",), ("",))
    assert tuples(files.parse_git_log(lines), "hash", "subject", "author", "commit_date") == [
        ("", "", "", ""), ("h", "a ", " b", "me"), ("h", "fix: x", "me", "2024-01-01")]


def test_manifest(rows):
    text = json.dumps({"dependencies": {"a": "1", "b": "2"}, "devDependencies": {"b": "3", "c": "4"}})
    docs = rows("project_id bigint, manifest_json string", (1, text), (2, "{}"), (3, "broken"))
    both = manifests.explode_manifest(docs, include_dev=True)
    assert tuples(both, "name", "version_range", "dep_scope") == [("a", "1", "prod"), ("b", "3", "dev"), ("c", "4", "dev")]
    assert tuples(manifests.explode_manifest(docs), "name", "version_range") == [("a", "1"), ("b", "2")]


def test_audit_documents(rows):
    vulns = {
        "a": {"severity": None, "cvss": {"score": "high", "vector": "v"}},
        "b": {"id": "X", "severity": "CRITICAL", "version": "1", "cvss": {"score": 9, "vector": "v"}, "cwe": ["C"]},
    }
    vulns["c"] = {"severity": "low", "cvss": {"score": "7.5", "vector": "v"}}
    vulns["d"] = {"severity": "low", "cvss": {"score": 7.5, "vector": 5}}
    vulns["e"] = {"severity": "low", "cvss": "none"}
    docs = rows("project_id bigint, audit_json string", (1, json.dumps({"vulnerabilities": vulns})),
                (2, "{}"), (3, '{"vulnerabilities":{}}'), (4, None))
    found = manifests.parse_audit_json(docs, "T").orderBy("seq").collect()
    assert [(r["project_id"], r["seq"], r["id"], r["severity"], r["version"]) for r in found[:2]] == [
        (1, 0, "npm-a-T", "moderate", "unknown"), (1, 1, "X", "critical", "1")]
    assert [r["package"] for r in found] == list("abcde")
    assert [r["cvss"] is None for r in found] == [True, False, True, True, True]
    assert found[1]["cvss"]["score"] == 9.0
    assert found[0]["title"] == "Vulnerability in a" and found[0]["cwe"] == [] and found[1]["refs"] == []


def test_history_missing_or_corrupt(spark, tmp_path):
    assert history.read_event_history(spark, str(tmp_path / "none.json")).count() == 0
    broken = tmp_path / "broken.json"
    broken.write_text("[{ not json")
    assert history.read_event_history(spark, str(broken), multi_line=True).count() == 0
    whole = tmp_path / "whole.json"
    whole.write_text(json.dumps([{"seq": 1, "type": "scan"}, {"seq": 2, "type": "audit"}]))
    assert tuples(history.read_event_history(spark, str(whole), multi_line=True), "seq") == [(1,), (2,)]


def test_append_stamps_the_time(spark, rows, tmp_path):
    events = rows("seq bigint, type string, ts timestamp", (1, "scan", dt.datetime(1999, 1, 1)))
    path = str(tmp_path / "events")
    history.append_events(events, path)
    history.append_events(events, path)
    found = spark.read.parquet(path)
    assert found.count() == 2 and found.filter(F.year("ts") < 2020).count() == 0


def test_unknown_export_format(rows, tmp_path):
    with pytest.raises(ValueError):
        history.export_table(rows("a int", (1,)), str(tmp_path / "x"), "yaml")


class FakeSession:
    """Just enough of a session to ask where scratch tables go."""

    def __init__(self, master, folder=None):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app"})
        self.conf = {} if folder is None else {"spark.checkpoint.dir": folder}


def test_scratch_folder_is_the_named_one():
    assert scratch_dir(FakeSession("yarn", "s3://shared/"), "x").startswith("s3://shared/x-")
    assert "release-guard-app" in scratch_dir(FakeSession("local[2]"), "x")
    with pytest.raises(ValueError):
        scratch_dir(FakeSession("yarn"), "x")


METRIC = "seq bigint, ts timestamp_ntz, type string, value double, unit string, source string"


def put(rows, path, *data, schema=METRIC):
    rows(schema, *data).coalesce(1).write.mode("append").parquet(path)


def run(stream, sink, checkpoint, mode="append"):
    jobs.run_available(stream, sink, checkpoint, mode).awaitTermination(60)


def test_late_and_repeated_metrics(spark, rows, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def step(*data):
        put(rows, source, *data)
        stream = jobs.read_table_stream(spark, source, METRIC)
        run(jobs.metrics_with_retention(stream, days=30), sink, checkpoint)

    step((1, DAY, "cpu", 1.0, "%", "h"), (2, DAY + dt.timedelta(days=90), "cpu", 1.0, "%", "h"))
    step((2, DAY + dt.timedelta(days=90), "cpu", 1.0, "%", "h"), (3, DAY + dt.timedelta(days=1), "cpu", 1.0, "%", "h"),
         (4, DAY + dt.timedelta(days=89), "cpu", 1.0, "%", "h"))
    assert tuples(spark.read.parquet(sink), "seq") == [(1,), (2,), (4,)]


def test_alert_state_over_batches(spark, rows, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "alert_id bigint, action string, actor string, ts timestamp_ntz, seq bigint"

    def step(*data):
        put(rows, source, *data, schema=schema)
        stream = jobs.read_table_stream(spark, source, schema)
        run(state.alert_state_stream(stream), jobs.batch_writer(sink), checkpoint, "update")

    step((1, "acknowledge", "late", DAY + dt.timedelta(days=2), 5))
    step((1, "acknowledge", "early", DAY, 1), (1, "resolve", "x", DAY, 2), (2, "comment", "x", DAY, 3))
    last = spark.read.parquet(sink).orderBy("batch").collect()
    final = {r["alert_id"]: (r["acknowledged"], r["acknowledged_by"], r["resolved"]) for r in last}
    assert final == {1: (True, "late", True), 2: (False, None, False)}


def test_deployment_state_over_batches(spark, rows, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "deployment_id bigint, approver string, action string, ts timestamp_ntz, seq bigint"
    requests = rows("deployment_id bigint, environment string, auto_approve boolean, strategy string",
                    (1, "production", False, None), (2, "staging", False, ""), (3, "nowhere", True, None))

    def step(*data):
        put(rows, source, *data, schema=schema)
        stream = jobs.read_table_stream(spark, source, schema)
        states = state.deployment_state_stream(stream, requests, deployments.environment_table(spark))
        run(states, jobs.batch_writer(sink), checkpoint, "update")

    step((1, "dev-lead", "approve", DAY, 1), (2, "dev-lead", "reject", DAY, 2))
    step((1, "ops-lead", "approve", DAY, 3), (2, "dev-lead", "approve", DAY + dt.timedelta(1), 4), (3, "dev-lead", "approve", DAY, 5))
    seen = [(r["deployment_id"], r["status"]) for r in spark.read.parquet(sink).orderBy("batch", "deployment_id").collect()]
    assert seen == [(1, "pending"), (2, "cancelled"), (1, "approved"), (2, "cancelled"), (3, "invalid")]


def test_notify_again_leaves_no_duplicates(spark, rows, tmp_path):
    metrics = rows(METRIC, (1, DAY, "cpu", 90.0, "%", "h"))
    alerts = monitoring.threshold_join(metrics, monitoring.threshold_table(spark))
    write = jobs.notify_batch(["u1", "u2"], str(tmp_path / "outbox"))
    write(alerts, 0)
    write(alerts, 0)
    assert tuples(spark.read.parquet(str(tmp_path / "outbox")), "url") == [("u1",), ("u2",)]


def test_xml_reports_are_cut_into_files(spark, rows, tmp_path, monkeypatch):
    from release_guard.operators.test_runs import suite_summary

    monkeypatch.setattr(history, "XML_SUITES", 7)
    data = [(i, "jest", "local", "passed", 1.0) for i in range(50)]
    results = rows("run_id long, framework string, environment string, status string, duration_ms double", *data)
    path = str(tmp_path / "xml")
    history.export_test_report(suite_summary(results).coalesce(1), path, "xml")
    sizes = [f.read_text().count("<testsuite ") for f in (tmp_path / "xml").glob("part-*")]
    assert sum(sizes) == 50 and max(sizes) <= 7
    assert sorted(r["_id"] for r in history.read_test_report(spark, path).collect()) == list(range(50))
