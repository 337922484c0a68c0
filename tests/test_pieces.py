"""Running values in pieces, as-of joins, lifetimes, ordered changes."""

from __future__ import annotations

import datetime as dt
import random

from release_guard.operators import deployments as d
from release_guard.operators import secrets as s
from release_guard.operators.pieces import running

DAY = dt.datetime(2024, 1, 1)


def at(hours):
    return None if hours is None else DAY + dt.timedelta(hours=hours)


def test_running_values_and_numbers(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", None, "b", f"k{i % 9}"]), rng.randint(0, 50), i, rng.choice([None, None, 1 << 60, i]),
             rng.choice([None, None, None, ("x", i)])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t int, seq int, v long, w struct<a:string,b:int>").repartition(5)
    for parts in ("1", "4", "37"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            found = {r["seq"]: (r["k"], r["v"], r["w"] and tuple(r["w"]), r["n"]) for r in running(df, ["k"], ["t", "seq"], ["v", "w"]).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        state, wanted = {}, {}
        for k, _, seq, v, w in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
            old = state.get(k, (None, None, 0))
            state[k] = (old[0] if v is None else v, old[1] if w is None else w, old[2] + 1)
            wanted[seq] = (k, *state[k])
        assert found == wanted
    assert running(df.limit(0), ["k"], ["t", "seq"], ["v"]).count() == 0


def test_a_hot_key_spreads(spark):
    df = spark.range(20_000).selectExpr("1 as k", "id as t", "if(id % 1000 = 0, id, null) as v").repartition(4)
    found = running(df, ["k"], ["t"], ["v"])
    assert found.where("v <> t - t % 1000 or n <> t + 1").count() == 0
    pieces = [r["count"] for r in found.groupBy((found["t"] * 0).alias("z")).count().collect()]
    assert pieces == [20_000]


def test_newest_scan_of_every_cut_off(rows):
    scans = rows(
        "project_id long, scan_id long, scan_ts timestamp_ntz, version string",
        (1, 1, at(1), "a"), (1, 2, at(5), "b"), (1, 3, at(5), "c"), (1, 4, None, "d"), (2, 5, at(3), "e"), (None, 6, at(0), "f"),
    )
    cuts = rows(
        "project_id long, since timestamp_ntz, note string",
        (1, at(0), "before"), (1, at(1), "same"), (1, at(4), "between"), (1, at(5), "tie"), (1, at(9), "after"),
        (1, None, "none"), (2, at(9), "two"), (3, at(9), "unknown"), (None, at(1), "null"), (1, at(9), "after"),
    )
    found = sorted((r["note"], r["scan_id"], r["version"]) for r in s.baselines_as_of(scans, cuts).collect())
    assert [f for f in found if f[1]] == [
        ("after", 3, "c"), ("after", 3, "c"), ("between", 1, "a"), ("null", 6, "f"), ("same", 1, "a"), ("tie", 3, "c"), ("two", 5, "e"),
    ]
    assert sorted(f[0] for f in found if not f[1]) == ["before", "none", "unknown"]


def test_findings_come_back(rows):
    scans = rows("project_id long, scan_id long, scan_ts timestamp_ntz", *[(1, i, at(i)) for i in range(6)], (2, 9, at(0)))
    held = {"x": [0, 1, 4], "y": [5], "z": [0, 1, 2, 3, 4, 5]}
    findings = rows(
        "project_id long, scan_id long, file string, pattern_name string, value string",
        *[(1, i, "f", "p", v) for v, seen in held.items() for i in seen], (1, 0, "f", "p", "x"), (2, 9, "f", "p", "x"), (1, 77, "f", "p", "w"),
    )
    columns = ["project_id", "value", "occurrence", "event", "introduced_at", "last_seen_at", "fixed_at", "scans"]
    assert sorted(map(tuple, s.finding_lifetimes(scans, findings).select(columns).collect()), key=repr) == sorted([
        (1, "x", 1, "introduced", at(0), at(1), at(2), 2), (1, "x", 2, "reintroduced", at(4), at(4), at(5), 1),
        (1, "y", 1, "introduced", at(5), at(5), None, 1), (1, "z", 1, "introduced", at(0), at(5), None, 6),
        (2, "x", 1, "introduced", at(0), at(0), None, 1),
    ], key=repr)


def test_copies_count_in_the_difference(rows):
    now, before = rows("v string", ("a",), ("a",), ("a",), ("b",)), rows("v string", ("a",), ("b",), ("b",), ("c",))
    assert [r["v"] for r in s.added_copies(now, before).collect()] == ["a", "a"]
    assert sorted(r["v"] for r in s.added_copies(before, now).collect()) == ["b", "c"]


def test_changes_in_order(rows):
    schema = "name string, type string, strategy string, auto boolean, required array<string>"
    current = rows(schema, ("dev", "t0", "s0", False, ["a"]), ("prod", "t0", "s0", False, []))
    updates = rows(
        "seq long, op string, " + schema,
        (3, "update", "dev", "t3", None, None, None), (1, "update", "dev", "t1", "s1", None, ["b", "c"]),
        (2, "update", "new", "early", None, None, None), (4, "add", "new", "t4", "s4", True, ["x"]),
        (5, "update", "new", None, None, False, None), (6, "add", "new", "t6", None, None, None), (7, "update", "new", "t7", None, None, None),
        (8, "add", "dev", "t8", "s8", True, None), (9, "update", "dev", None, None, True, []),
    )
    found = d.upsert_environments(current, updates).select("name", "added_by", "type", "strategy", "auto", "required", "error")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([
        ("dev", None, "t3", "s1", True, [], None), ("dev", 8, "t8", "s8", True, None, None), ("prod", None, "t0", "s0", False, [], None),
        ("new", 4, "t7", "s4", False, ["x"], None), ("new", 6, "t6", None, None, None, None),
        ("new", 2, "early", None, None, None, "Environment 'new' not found"),
    ], key=repr)
