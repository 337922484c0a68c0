"""Test suites and run reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules

SUITE_KEY = ["run_id", "framework", "environment"]


def suite_matrix(
    runs: DataFrame,
    frameworks: Sequence[str] = tuple(rules.TEST_FRAMEWORKS),
    environments: Sequence[str] = tuple(rules.TEST_ENVIRONMENTS),
    only_frameworks: Sequence[str] | None = None,
    only_environments: Sequence[str] | None = None,
) -> DataFrame:
    """The suites planned for each run: every chosen framework in every environment.

    The two name lists come from configuration; the pairs are one literal array.
    """
    pairs = [
        F.struct(F.lit(f).alias("framework"), F.lit(e).alias("environment"))
        for f in frameworks
        for e in environments
        if (only_frameworks is None or f in only_frameworks)
        and (only_environments is None or e in only_environments)
    ]
    if not pairs:
        raise ValueError("no framework or no environment left")
    return (
        runs.select("run_id", F.explode(F.array(*pairs)).alias("p"))
        .select("run_id", "p.*")
        .withColumn("name", F.concat_ws("-", "framework", "environment"))
        .withColumn("status", F.lit("pending"))
    )


def _counts() -> list:
    return [
        F.count("*").alias("total_tests"),
        F.count_if(F.col("status") == "passed").alias("passed_tests"),
        F.count_if(F.col("status") == "failed").alias("failed_tests"),
        F.count_if(F.col("status") == "skipped").alias("skipped_tests"),
        F.sum("duration_ms").alias("duration_ms"),
    ]


def suite_summary(results: DataFrame) -> DataFrame:
    """Totals and status of every suite of every run."""
    return (
        results.groupBy(*SUITE_KEY)
        .agg(*_counts())
        .withColumn("name", F.concat_ws("-", "framework", "environment"))
        .withColumn("status", F.when(F.col("failed_tests") > 0, "failed").otherwise("passed"))
    )


def report_summary(results: DataFrame) -> DataFrame:
    """Totals of every run over its suites."""
    return (
        suite_summary(results)
        .groupBy("run_id")
        .agg(
            F.count("*").alias("total_suites"),
            *[
                F.sum(c).alias(c)
                for c in ("total_tests", "passed_tests", "failed_tests", "skipped_tests", "duration_ms")
            ],
        )
        .withColumn("status", F.when(F.col("failed_tests") > 0, "failed").otherwise("passed"))
    )


def latest_reports(reports: DataFrame, limit: int) -> DataFrame:
    """The last reports in order of run."""
    return reports.orderBy(F.desc("run_id")).limit(limit).orderBy("run_id")


def suites_of_report(results: DataFrame, run_id: int) -> DataFrame:
    """The suites of one run; an unknown run gives no rows."""
    return suite_summary(results.filter(F.col("run_id") == run_id))
