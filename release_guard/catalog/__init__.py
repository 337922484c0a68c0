"""The registered queries: one job per entry, with its check in SQL.

A query takes a session and a folder of driver tables. The SQL runs on the same
tables in another engine; entries without SQL are tested by hand-made cases.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = [
    "secrets", "versions", "vulnerabilities", "licenses", "analytics", "monitoring", "deployments",
    "test_runs", "issues", "gates", "reports", "sources", "streams",
]


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"{__name__}.{name}"), attribute)
        clash = merged.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        merged |= part
    return merged


def queries() -> dict[str, Query]:
    return _merged("QUERIES")


def oracles() -> dict[str, str]:
    return _merged("ORACLES")
