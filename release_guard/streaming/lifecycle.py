"""Deployments, alerts and cached audits as keyed state with event-time timers.

Each job reads two kinds of rows as one stream, or the newest rows of one kind, and keeps one short record per key. A key that is
finished leaves the store when the watermark passes its end by ``keep``; rows that refer to a key
nobody announced wait as long and leave too, so the store holds what is open, not what ever was. Run them in
output mode ``update``; every micro-batch emits the keys it changed.

Order does not matter: first and last actions are chosen by (ts, seq), not by arrival. Of two streams the one
that lags sets the watermark, so none of its rows is late because the other is ahead.
"""

from __future__ import annotations

import datetime as dt
import pickle
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.deployments import strategy_table, validate_requests
from ..session import ship_package

# How long a finished key, or an action without its subject, is kept, in milliseconds of event time.
KEEP_MS = 24 * 3600 * 1000
# Into how many buckets the keys of a stream fall; a checkpoint is tied to it.
BUCKETS = 1 << 14
EPOCH = dt.datetime(1970, 1, 1)


def _millis(at: dt.datetime) -> int:
    zone = at.tzinfo
    return int((at - (EPOCH if zone is None else EPOCH.replace(tzinfo=dt.UTC))).total_seconds() * 1000)


class _Lifecycle(StatefulProcessor):
    """One record per key; subclasses fold rows into it and say what it shows and when it ends.

    Every call to the store leaves the Python worker, so the records of a bucket of keys are one value of it with one timer, and
    the calls grow with the buckets, not with the keys. A batch writes the buckets it touches.
    """

    SCHEMA = ""
    SHOWN: list[str] = []

    def __init__(self, keep_ms: int, key: str) -> None:
        self.keep_ms, self.key = keep_ms, key
        self.names = [part.split()[0] for part in self.SCHEMA.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "records binary, timer long")

    def _held(self) -> tuple[dict[Any, tuple], int | None]:
        """The records of the bucket by key, each with its own time to leave at the end, and the bucket's timer."""
        held = self.bucket.get()
        return ({}, None) if held is None else (pickle.loads(bytes(held[0])), held[1])

    def _keep(self, records: dict[Any, tuple], timer: int | None) -> None:
        """Store the records; the bucket's timer is that of the record that leaves first."""
        first = min((r[-1] for r in records.values() if r[-1] is not None), default=None)
        if timer != first:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if records:
            self.bucket.update((pickle.dumps(records, 5), first))
        else:
            self.bucket.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        records, timer = self._held()
        touched: dict[Any, dict[str, Any]] = {}
        for row in rows:
            one = row[self.key]
            if one not in touched:
                held = records.get(one)
                touched[one] = self.empty() if held is None else dict(zip(self.names, held, strict=False))
            self.fold(touched[one], row)
        passed = timerValues.getCurrentWatermarkInMs()
        for one, state in touched.items():
            end = self.end(state)
            # What the watermark has passed already leaves with the next batch.
            wanted = None if end is None else max(end + self.keep_ms, passed + 1)
            records[one] = (*[state[n] for n in self.names], wanted)
        self._keep(records, timer)
        for one, state in touched.items():
            yield from self._rows(self.show((one,), state))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        records, _ = self._held()
        passed = timerValues.getCurrentWatermarkInMs()
        gone = [one for one, record in records.items() if record[-1] is not None and record[-1] <= passed]
        left = [(one, dict(zip(self.names, records.pop(one), strict=False))) for one in gone]
        # Spark takes the expired timer away by itself.
        self._keep(records, None)
        for one, state in left:
            yield from self._rows(self.leave((one,), state))

    def _rows(self, shown: tuple | None) -> Iterator[Row]:
        if shown is not None:
            yield Row(*self.SHOWN)(*shown)

    def close(self) -> None:
        pass

    def empty(self) -> dict[str, Any]:
        raise NotImplementedError

    def fold(self, state: dict[str, Any], row: Row) -> None:
        raise NotImplementedError

    def end(self, state: dict[str, Any]) -> int | None:
        """When the key is finished, in milliseconds; None while it is open."""
        raise NotImplementedError

    def show(self, key: Any, state: dict[str, Any]) -> tuple | None:
        raise NotImplementedError

    def leave(self, key: Any, state: dict[str, Any]) -> tuple | None:
        return None


def _at(ts: dt.datetime, seq: int) -> str:
    """A moment that sorts as text: microseconds and number."""
    micros = (ts.replace(tzinfo=None) - EPOCH) // dt.timedelta(microseconds=1)
    return f"{micros + (1 << 62):020d}:{seq + (1 << 62):020d}"


class _Deployment(_Lifecycle):
    """A request with the first approval of each approver and the first rejection."""

    SCHEMA = "known boolean, environment string, required array<string>, error string, votes map<string,string>, rejected string, last long"
    SHOWN = ["deployment_id", "environment", "open_approvals", "status", "error"]

    def empty(self) -> dict[str, Any]:
        return {"known": False, "environment": None, "required": [], "error": None, "votes": {}, "rejected": None, "last": 0}

    def fold(self, state: dict[str, Any], row: Row) -> None:
        state["last"] = max(state["last"], _millis(row["ts"]))
        if row["action"] == "request":
            state |= {"known": True, "environment": row["environment"], "error": row["error"], "required": row["required"] or []}
            return
        at = _at(row["ts"], row["seq"])
        if row["action"] == "reject" and (state["rejected"] is None or at < state["rejected"]):
            state["rejected"] = at
        # A rejection also settles the approval that this approver owes.
        if row["action"] in ("approve", "reject") and row["approver"] is not None:
            name = f"{row['action']} {row['approver']}"
            state["votes"] = {**state["votes"], name: min(state["votes"].get(name, at), at)}

    def _open(self, state: dict[str, Any]) -> int:
        if state["error"] is not None:
            return 0
        votes, rejected = state["votes"], state["rejected"]

        def settled(name: str) -> bool:
            given = votes.get(f"approve {name}")
            return f"reject {name}" in votes or given is not None and (rejected is None or given < rejected)

        return sum(not settled(name) for name in set(state["required"]))

    def _status(self, state: dict[str, Any]) -> str:
        if state["error"] is not None:
            return "invalid"
        if state["rejected"] is not None:
            return "cancelled"
        return "pending" if self._open(state) else "approved"

    def end(self, state: dict[str, Any]) -> int | None:
        return None if state["known"] and self._status(state) == "pending" else state["last"]

    def show(self, key: Any, state: dict[str, Any]) -> tuple | None:
        if not state["known"]:
            return None
        return (key[0], state["environment"], self._open(state), self._status(state), state["error"])


def deployment_lifecycle(
    requests: DataFrame, actions: DataFrame, environments: DataFrame, strategies: DataFrame | None = None,
    delay: str = "1 hour", keep_ms: int = KEEP_MS,
) -> DataFrame:
    """State of deployments from a stream of requests and a stream of actions.

    ``requests(deployment_id, environment, strategy, auto_approve, ts)``, ``actions(deployment_id, approver, action, ts, seq)``.
    A request comes out with its arrival: invalid, approved where nobody has to approve, else pending. Actions may
    come before their request. Cancelled, approved and invalid deployments leave after ``keep_ms``.
    """
    strategies = strategy_table(environments.sparkSession) if strategies is None else strategies
    nobody = F.array().cast("array<string>")
    env = environments.select(
        F.col("name").alias("environment"), F.col("auto_approve").alias("env_auto"), "required_approvers"
    )
    automatic = F.coalesce("env_auto", F.lit(False)) | F.coalesce("auto_approve", F.lit(False))
    valid = validate_requests(requests, environments, strategies).join(env, "environment", "left")
    asked = valid.select(
        "deployment_id", F.lit("request").alias("action"), _instant("ts"), F.lit(0).cast("long").alias("seq"),
        F.lit(None).cast("string").alias("approver"), "environment", "error",
        F.when(automatic, nobody).otherwise(F.coalesce("required_approvers", nobody)).alias("required"),
    )
    none = F.lit(None).cast("string")
    done = actions.select(
        "deployment_id", "action", _instant("ts"), F.col("seq").cast("long").alias("seq"), "approver",
        none.alias("environment"), none.alias("error"), nobody.alias("required"),
    )
    both = asked.withWatermark("ts", delay).union(done.withWatermark("ts", delay))
    key = requests.schema["deployment_id"].dataType.simpleString()
    return _run(both, "deployment_id", _Deployment(keep_ms, "deployment_id"),
                f"deployment_id {key}, environment string, open_approvals long, status string, error string")


class _Alert(_Lifecycle):
    """An alert with its last acknowledgement and its last resolution."""

    SHOWN = ["alert_id", "acknowledged", "acknowledged_by", "at", "resolved", "done"]
    SCHEMA = "known boolean, acknowledged string, by string, at long, resolved string, done long, last long"

    def empty(self) -> dict[str, Any]:
        return {"known": False, "acknowledged": None, "by": None, "at": None, "resolved": None, "done": None, "last": 0}

    def fold(self, state: dict[str, Any], row: Row) -> None:
        state["last"] = max(state["last"], _millis(row["ts"]))
        at = _at(row["ts"], row["seq"])
        micros = (row["ts"].replace(tzinfo=None) - EPOCH) // dt.timedelta(microseconds=1)
        if row["action"] == "alert":
            state["known"] = True
        elif row["action"] == "acknowledge" and (state["acknowledged"] is None or at > state["acknowledged"]):
            state |= {"acknowledged": at, "by": row["actor"], "at": micros}
        elif row["action"] == "resolve" and (state["resolved"] is None or at > state["resolved"]):
            state |= {"resolved": at, "done": micros}

    def end(self, state: dict[str, Any]) -> int | None:
        return None if state["known"] and state["resolved"] is None else state["last"]

    def show(self, key: Any, state: dict[str, Any]) -> tuple | None:
        if not state["known"]:
            return None
        acknowledged, resolved = state["acknowledged"] is not None, state["resolved"] is not None
        return (key[0], acknowledged, state["by"], state["at"], resolved, state["done"])


def alert_lifecycle(
    alerts: DataFrame, actions: DataFrame, delay: str = "1 hour", keep_ms: int = KEEP_MS
) -> DataFrame:
    """State of alerts from a stream of alerts and a stream of actions; resolved alerts leave after ``keep_ms``.

    ``alerts(alert_id, ts)``, ``actions(alert_id, action, actor, ts, seq)``. Actions on alerts that never come have no effect.
    """
    raised = alerts.select(
        "alert_id", F.lit("alert").alias("action"), F.lit(None).cast("string").alias("actor"), _instant("ts"),
        F.lit(0).cast("long").alias("seq"),
    )
    done = actions.select("alert_id", "action", "actor", _instant("ts"), F.col("seq").cast("long").alias("seq"))
    both = raised.withWatermark("ts", delay).union(done.withWatermark("ts", delay))
    key = alerts.schema["alert_id"].dataType.simpleString()
    states = _run(both, "alert_id", _Alert(keep_ms, "alert_id"),
                  f"alert_id {key}, acknowledged boolean, acknowledged_by string, at long, resolved boolean, done long")
    return states.select(
        "alert_id", "acknowledged", "acknowledged_by", F.timestamp_micros("at").alias("acknowledged_at"),
        "resolved", F.timestamp_micros("done").alias("resolved_at"),
    )


class _CachedAudit(_Lifecycle):
    """The newest audit of a key, valid until its time is up."""

    SCHEMA = "newest string, snapshot long, at long"
    SHOWN = ["cache_key", "snapshot_id", "at", "valid"]

    def empty(self) -> dict[str, Any]:
        return {"newest": None, "snapshot": None, "at": None}

    def fold(self, state: dict[str, Any], row: Row) -> None:
        at = _at(row["fetched_at"], row["snapshot_id"])
        if state["newest"] is None or at > state["newest"]:
            micros = (row["fetched_at"].replace(tzinfo=None) - EPOCH) // dt.timedelta(microseconds=1)
            state |= {"newest": at, "snapshot": row["snapshot_id"], "at": micros}

    def end(self, state: dict[str, Any]) -> int | None:
        # The first millisecond in which the audit is no longer younger than its time limit.
        return -(-state["at"] // 1000)

    def show(self, key: Any, state: dict[str, Any]) -> tuple | None:
        return (key[0], state["snapshot"], state["at"], True)

    def leave(self, key: Any, state: dict[str, Any]) -> tuple | None:
        return (key[0], state["snapshot"], state["at"], False)


def audit_cache(snapshots: DataFrame, ttl_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """The newest audit per key with ``valid``, which turns false when the watermark reaches the end of its time.

    ``snapshots(cache_key, snapshot_id, fetched_at)`` is a stream. Of equal times the greater id is newer.
    """
    read = snapshots.select("cache_key", F.col("snapshot_id").cast("long").alias("snapshot_id"), _instant("fetched_at"))
    key = snapshots.schema["cache_key"].dataType.simpleString()
    states = _run(read.withWatermark("fetched_at", delay), "cache_key", _CachedAudit(ttl_seconds * 1000, "cache_key"),
                  f"cache_key {key}, snapshot_id long, at long, valid boolean")
    return states.select("cache_key", "snapshot_id", F.timestamp_micros("at").alias("fetched_at"), "valid")


def _instant(column: str) -> Column:
    return F.col(column).cast("timestamp").alias(column)


def _run(rows: DataFrame, key: str, processor: _Lifecycle, schema: str) -> DataFrame:
    ship_package(rows.sparkSession)
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    return bucketed.groupBy("bucket").transformWithState(
        statefulProcessor=processor, outputStructType=schema, outputMode="update", timeMode="eventTime"
    )
