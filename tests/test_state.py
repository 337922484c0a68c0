"""Keyed state over batches, deliveries, batches with an id, payloads."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from release_guard import catalog
from release_guard.catalog import sources
from release_guard.operators import delivery, deployments, monitoring
from release_guard.sources import history
from release_guard.streaming import jobs, lifecycle

DAY = dt.datetime(2024, 1, 1)
REQUEST = "deployment_id bigint, environment string, strategy string, auto_approve boolean, ts timestamp_ntz"
ACTION = "deployment_id bigint, approver string, action string, ts timestamp_ntz, seq bigint"
HOUR = dt.timedelta(hours=1)


@pytest.fixture
def steps(spark, rows, tmp_path):
    """Run a stream over folders that grow from step to step; the rows of each micro-batch."""

    class Steps:
        def __init__(self, make, **schemas):
            self.schemas = schemas
            for name, schema in schemas.items():
                rows(schema).write.parquet(self.path(name))
            self.frame = make(**{n: jobs.read_table_stream(spark, self.path(n), s) for n, s in schemas.items()})

        def path(self, name):
            return str(tmp_path / name)

        def run(self, **data):
            for name, values in data.items():
                rows(self.schemas[name], *values).coalesce(1).write.mode("append").parquet(self.path(name))
            seen = self.batches()
            jobs.run_available(self.frame, jobs.batch_writer(self.path("out")), self.path("check"), "update").awaitTermination()
            made = [r for r in spark.read.parquet(self.path("out")).collect() if r["batch"] not in seen]
            return sorted(tuple(r)[:-1] for r in made)

        def batches(self):
            try:
                return {r["batch"] for r in spark.read.parquet(self.path("out")).select("batch").collect()}
            except Exception:
                return set()

    return Steps


def test_deployments_over_batches(spark, steps):
    flow = steps(
        lambda requests, actions: lifecycle.deployment_lifecycle(requests, actions, deployments.environment_table(spark)),
        requests=REQUEST, actions=ACTION,
    )
    # An action before its request, a request that nobody has to approve, one that cannot be.
    assert flow.run(
        requests=[(1, "production", None, False, DAY), (2, "development", None, False, DAY), (3, "nowhere", None, True, DAY)],
        actions=[(4, "dev-lead", "approve", DAY, 1), (1, "dev-lead", "approve", DAY, 2)],
    ) == [(1, "production", 1, "pending", None), (2, "development", 0, "approved", None), (3, "nowhere", 0, "invalid", "Environment 'nowhere' not found")]
    assert flow.run(
        requests=[(4, "staging", "", False, DAY + HOUR), (5, "production", None, False, DAY + HOUR)],
        actions=[(1, "ops-lead", "approve", DAY + HOUR, 3), (5, "visitor", "reject", DAY + HOUR, 4)],
    ) == [(1, "production", 0, "approved", None), (4, "staging", 0, "approved", None), (5, "production", 2, "cancelled", None)]
    # Rows of both streams three days on move the watermark; what was finished has left, so its late action shows nothing.
    later = DAY + dt.timedelta(days=3)
    assert flow.run(
        requests=[(6, "staging", None, False, later)], actions=[(77, "visitor", "approve", later, 9)]
    ) == [(6, "staging", 1, "pending", None)]
    assert flow.run(actions=[(1, "ops-lead", "reject", later, 5), (6, "dev-lead", "approve", later, 6)]) == [(6, "staging", 0, "approved", None)]


def test_alerts_over_batches(spark, steps):
    flow = steps(lifecycle.alert_lifecycle, alerts="alert_id bigint, ts timestamp_ntz",
                 actions="alert_id bigint, action string, actor string, ts timestamp_ntz, seq bigint")
    first = flow.run(alerts=[(1, DAY), (2, DAY)], actions=[(1, "acknowledge", "late", DAY + HOUR, 2), (9, "resolve", "x", DAY, 1)])
    assert [r[:3] + (r[4],) for r in first] == [(1, True, "late", False), (2, False, None, False)]
    second = flow.run(actions=[(1, "acknowledge", "early", DAY, 1), (1, "resolve", "a", DAY + HOUR, 3), (2, "comment", "b", DAY, 4)])
    assert [r[:3] + (r[4],) for r in second] == [(1, True, "late", True), (2, False, None, False)]
    later = DAY + dt.timedelta(days=3)
    assert [r[0] for r in flow.run(alerts=[(3, later)], actions=[(77, "comment", "c", later, 9)])] == [3]
    # Alert 1 was resolved and has left, alert 2 is open and still there.
    assert [r[0] for r in flow.run(actions=[(1, "comment", "c", later, 5), (2, "resolve", "c", later, 6)])] == [2]


def test_audits_leave_when_their_time_is_up(spark, steps):
    flow = steps(lambda snapshots: lifecycle.audit_cache(snapshots, 3600), snapshots="cache_key string, snapshot_id bigint, fetched_at timestamp_ntz")
    assert [(r[0], r[1], r[3]) for r in flow.run(snapshots=[("a", 1, DAY), ("a", 2, DAY), ("b", 3, DAY + HOUR / 2)])] == [("a", 2, True), ("b", 3, True)]
    assert [(r[0], r[1], r[3]) for r in flow.run(snapshots=[("c", 4, DAY + HOUR)])] == [("a", 2, False), ("c", 4, True)]
    assert [(r[0], r[1], r[3]) for r in flow.run(snapshots=[("a", 5, DAY + 3 * HOUR)])] == [("a", 5, True), ("b", 3, False), ("c", 4, False)]


OUTBOX = "event_id bigint, url string, ts timestamp_ntz, payload string"


def test_a_failing_url_does_not_hold_the_others(spark, rows, tmp_path):
    path = str(tmp_path / "log")
    outbox = rows(OUTBOX, *[(e, u, DAY, "{}") for e in (1, 2) for u in ("good", "bad", "slow")], (1, "good", DAY, "{}"))
    tried = []

    def send(due):
        tried.append(sorted((r["event_id"], r["url"], r["attempt"]) for r in due.collect()))
        return due.withColumn("ok", F.when(F.col("url") == "good", True).when(F.col("url") == "slow", F.col("attempt") >= 2))

    def state(now):
        found = delivery.delivery_state(outbox, delivery.read_attempts(spark, path), 3, 60)
        return {(r["event_id"], r["url"]): (r["tries"], r["status"]) for r in found.collect()}, delivery.due_deliveries(found, now).count()

    def at(minutes):
        return F.lit(DAY + dt.timedelta(minutes=minutes)).cast("timestamp_ntz")

    assert set(state(at(0))[0].values()) == {(0, "new")} and state(at(-1))[1] == 0
    delivery.deliver_round(outbox, path, "a", at(0), send, 3, 60)
    assert state(at(0.5)) == ({(e, u): (1, "delivered" if u == "good" else "waiting") for e in (1, 2) for u in ("good", "bad", "slow")}, 0)
    for _ in range(2):
        # Run again after a failure: the same tries, logged once.
        delivery.deliver_round(outbox, path, "b", at(1), send, 3, 60)
    assert tried[1] == tried[2] == [(e, u, 2) for e in (1, 2) for u in ("bad", "slow")]
    found, due = state(at(2))
    assert found[1, "slow"] == (2, "delivered") and found[2, "bad"] == (2, "waiting") and due == 0
    delivery.deliver_round(outbox, path, "c", at(3), send, 3, 60)
    assert tried[3] == [(1, "bad", 3), (2, "bad", 3)] and state(at(99)) == (
        {(e, u): {"good": (1, "delivered"), "slow": (2, "delivered"), "bad": (3, "failed")}[u] for e in (1, 2) for u in ("good", "bad", "slow")}, 0)
    rate = {r["url"]: (r["deliveries"], r["failed"], r["success_rate"], r["tries"]) for r in
            delivery.delivery_rate(delivery.delivery_state(outbox, delivery.read_attempts(spark, path), 3, 60)).collect()}
    assert rate == {"good": (2, 0, 1.0, 2), "slow": (2, 0, 1.0, 4), "bad": (2, 2, 0.0, 6)}


def test_events_alike_make_one_outbox_row_each_per_url(spark, rows, tmp_path, monkeypatch):
    schema = "event_id bigint, user_id bigint, event_type string, value double, ts timestamp_ntz, props string"
    alike = [(30 * i, 1, "click", 1.0, DAY, "{}") for i in range(20)]
    rows(schema, *alike, (7, None, "click", 1.0, DAY, "{}"), (8, 1, "click", 1.0, None, "{}")).write.parquet(str(tmp_path / "events.parquet"))
    sizes = []
    send = delivery.deliver_round
    monkeypatch.setattr(delivery, "deliver_round", lambda outbox, *a, **b: (sizes.append(outbox.count()), send(outbox, *a, **b))[1])
    found = catalog.queries()["delivery_state"](spark, str(tmp_path)).collect()
    assert set(sizes) == {20 * len(sources.URLS)}
    assert sorted((r["event_id"], r["url"]) for r in found) == sorted((e[0], u) for e in alike for u in sources.URLS)


def test_attempts_after_a_success_do_not_count(rows):
    outbox = rows(OUTBOX, (1, "u", DAY, ""))
    attempts = rows("event_id bigint, url string, attempt bigint, ts timestamp_ntz, ok boolean",
                    (1, "u", 1, DAY, False), (1, "u", 1, DAY, False), (1, "u", 2, DAY + HOUR, True), (1, "u", 3, DAY + 2 * HOUR, False), (7, "x", 1, DAY, True))
    (row,) = delivery.delivery_state(outbox, attempts).collect()
    assert (row["tries"], row["status"], row["delivered_at"], row["next_try_at"]) == (2, "delivered", DAY + HOUR, None)


def test_outbox_and_log_are_shuffled_once_and_not_joined(spark, rows, tmp_path, capsys):
    path = str(tmp_path / "log")
    # A row without an id is never sent, of repeated rows one is.
    outbox = rows(OUTBOX, (1, "u", DAY + HOUR, "late"), (1, "u", DAY, "early"), (2, "v", DAY, None), (None, "u", DAY, "lost"), (3, None, DAY, "lost"))
    seen = []

    def send(due):
        due.explain()
        plan = capsys.readouterr().out
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
        seen.append(sorted(due.collect()))
        assert due.columns == ["event_id", "url", "ts", "payload", "attempt"]
        return due.withColumn("ok", F.col("event_id") == 1)

    delivery.deliver_round(outbox, path, "a", F.lit(DAY + HOUR).cast("timestamp_ntz"), send)
    (one, two) = seen[0]
    assert tuple(one) in {(1, "u", DAY, "early", 1), (1, "u", DAY + HOUR, "late", 1)} and tuple(two) == (2, "v", DAY, None, 1)
    found = delivery.delivery_state(outbox, delivery.read_attempts(spark, path)).collect()
    assert sorted(((r["event_id"] or 0, r["url"] or "", r["tries"], r["status"]) for r in found)) == [
        (0, "u", 0, "new"), (1, "u", 1, "delivered"), (2, "v", 1, "waiting"), (3, "", 0, "new")]


def test_a_batch_counts_once(spark, rows, tmp_path):
    path = str(tmp_path / "events")
    events = rows("seq bigint, ts timestamp_ntz", (1, DAY), (2, DAY))
    for now in (DAY, DAY + dt.timedelta(days=1)):
        history.append_batch(events, path, "one", F.lit(now).cast("timestamp_ntz"))
    history.append_batch(events, path, "two", F.lit(DAY).cast("timestamp_ntz"))
    found = spark.read.parquet(path)
    assert found.count() == 4 and found.where("batch = 'one' and ts > timestamp_ntz '2024-01-01 12:00:00'").count() == 2
    with pytest.raises(ValueError):
        history.append_batch(events, path, "../x")


def test_payload_holds_time_and_data(rows):
    given = ['{"a": {"b": [1, "x"]}}', "not json \"q\"", None, "7"]
    events = rows("event string, package string, version string, ts timestamp_ntz, data string",
                  *[("publish", f'p"{i}', "1.0.0", DAY + dt.timedelta(microseconds=1234567), d) for i, d in enumerate(given)])
    found = [json.loads(r["payload"]) for r in history.webhook_outbox(events, ["u"]).collect()]
    assert [f["data"] for f in found] == [{"a": {"b": [1, "x"]}}, 'not json "q"', {}, 7]
    assert {f["timestamp"] for f in found} == {"2024-01-01T00:00:01.234Z"} and found[0]["package"] == 'p"0'


def test_notifications_hold_the_whole_alert(rows):
    metrics = rows("seq bigint, ts timestamp_ntz, type string, value double, unit string, source string", (7, DAY, "cpu", 99.5, "%", "h1"))
    events = jobs.alert_events(monitoring.threshold_join(metrics, monitoring.threshold_table(metrics.sparkSession)))
    alert = json.loads(events.first()["data"])["alert"]
    assert alert == {"id": 7, "timestamp": "2024-01-01T00:00:00.000Z", "resolved": False, "acknowledged": False, "source": "h1",
                     "severity": "warning", "type": "cpu_high", "message": "CPU usage is high: 99.5%", "value": 99.5, "threshold": 80.0}


class CountedStore:
    """A store of one bucket that counts the calls to it."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def second(n):
    return DAY + dt.timedelta(seconds=n)


def test_store_calls_of_deployments_grow_with_buckets(spark):
    store, life = CountedStore(), lifecycle._Deployment(1000, "deployment_id")
    life.init(store)
    ask = {"action": "request", "seq": 0, "approver": None, "environment": "qa", "error": None, "required": []}
    shown = list(life.handleInputRows((0,), iter([{**ask, "deployment_id": i, "ts": second(i)} for i in range(500)]), Watermark(0)))
    assert [r[0] for r in shown] == list(range(500)) and {r[3] for r in shown} == {"approved"} and store.calls <= 4
    late = {**ask, "action": "reject", "deployment_id": 499, "ts": second(600), "approver": "x"}
    assert [tuple(r)[3] for r in life.handleInputRows((0,), iter([late]), Watermark(0))] == ["cancelled"]
    # All but the one that went on leave together, and the timer is that of the one that is left.
    end = lifecycle._millis(second(499)) + 1000
    assert list(life.handleExpiredTimer((0,), Watermark(end), None)) == []
    assert max(store.timers) == lifecycle._millis(second(600)) + 1000 and list(life._held()[0]) == [499]
    list(life.handleExpiredTimer((0,), Watermark(max(store.timers)), None))
    assert store.value is None


def test_store_calls_of_alerts_grow_with_buckets(spark):
    store, life = CountedStore(), lifecycle._Alert(1000, "alert_id")
    life.init(store)
    rows = [{"alert_id": i, "action": kind, "actor": "a", "ts": second(i), "seq": i} for i in range(400) for kind in ("alert", "resolve")]
    shown = list(life.handleInputRows((0,), iter(rows), Watermark(0)))
    assert len(shown) == 400 and all(r[4] for r in shown) and store.calls <= 4
    again = list(life.handleInputRows((0,), iter([{**rows[0], "action": "acknowledge"}]), Watermark(0)))
    assert [(r[0], r[1], r[4]) for r in again] == [(0, True, True)]
