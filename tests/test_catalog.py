"""Every registered query against its SQL, and what its plan must not contain."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from release_guard import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracles()
# The smallest document table holds no secret.
MAY_BE_EMPTY = ["scan_documents"]
STREAMS = [n for n in QUERIES if n.endswith(("_stream", "_lifecycle")) or n in ("metrics_with_retention", "audit_cache")]


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def test_all_queries_have_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    found = [[plain(r[c]) for c in columns] for r in frame.collect()]
    result = duck.sql(ORACLES[name])
    assert sorted(result.columns) == columns
    order = [result.columns.index(c) for c in columns]
    expected = [[plain(r[i]) for i in order] for r in result.fetchall()]
    assert sorted(map(repr, found)) == sorted(map(repr, expected))
    assert found or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(STREAMS)))
def test_plan_has_no_pairs_and_no_row_udf(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroups"):
        assert bad not in plan
