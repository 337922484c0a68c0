"""Alert and deployment state kept per key in a stream.

Each state is a few minima and maxima over the actions of a key, so it is an
ordinary streaming aggregation: Spark combines the actions of a key in each
task before the shuffle, and the store holds one short row per key. Run both in
output mode ``update``; every micro-batch then emits the keys it changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.deployments import required_approvals, strategy_table, validate_requests


def alert_state_stream(actions: DataFrame) -> DataFrame:
    """State of every alert an action touched.

    ``actions(alert_id, action, actor, ts, seq)``; acknowledging and resolving
    are independent and the last action of each kind wins.
    """

    def last(kind: str) -> Column:
        return F.max(F.when(F.col("action") == kind, F.struct("ts", "seq", "actor")))

    folded = actions.groupBy("alert_id").agg(
        last("acknowledge").alias("ack"), last("resolve").alias("res")
    )
    return folded.select(
        "alert_id",
        F.col("ack").isNotNull().alias("acknowledged"),
        F.col("ack.actor").alias("acknowledged_by"),
        F.col("ack.ts").alias("acknowledged_at"),
        F.col("res").isNotNull().alias("resolved"),
        F.col("res.ts").alias("resolved_at"),
    )


def deployment_state_stream(
    actions: DataFrame, requests: DataFrame, environments: DataFrame, strategies: DataFrame | None = None
) -> DataFrame:
    """State of every deployment an action touched.

    ``actions(deployment_id, approver, action, ts, seq)`` is a stream, the
    requests, environments and strategies are tables. Others than the approvers the environments
    name have no say but to reject. ``open_approvals`` counts the required approvals that did
    not come before the first rejection. An invalid request keeps that status and its error.
    """
    strategies = strategy_table(requests.sparkSession) if strategies is None else strategies
    # One name for each approver of the configuration, which becomes a column of the state.
    asked = environments.select(F.explode("required_approvers").alias("name")).distinct().collect()
    names = sorted(row["name"] for row in asked)

    def first(condition: Column) -> Column:
        return F.min(F.when(condition, F.struct("ts", "seq")))

    approved = F.col("action") == "approve"
    folded = actions.groupBy("deployment_id").agg(
        first(F.col("action") == "reject").alias("rejected"),
        *[first(approved & (F.col("approver") == n)).alias(f"by_{i}") for i, n in enumerate(names)],
    )

    def in_time(i: int) -> Column:
        return F.col(f"by_{i}").isNotNull() & (
            F.col("rejected").isNull() | (F.col(f"by_{i}") < F.col("rejected"))
        )

    given = F.array_compact(
        F.array(*[F.when(in_time(i), n) for i, n in enumerate(names)]).cast("array<string>")
    )
    still_open = F.size(F.array_except(F.col("required"), given)).cast("bigint")
    open_now = F.when(F.col("error").isNull(), still_open).otherwise(F.lit(0).cast("bigint"))
    status = (
        F.when(F.col("error").isNotNull(), "invalid")
        .when(F.col("rejected").isNotNull(), "cancelled")
        .when(still_open == 0, "approved")
        .otherwise("pending")
    )
    valid = validate_requests(requests, environments, strategies).select("deployment_id", "error")
    known = valid.join(required_approvals(requests, environments), "deployment_id")
    return folded.join(known, "deployment_id").select(
        "deployment_id", status.alias("status"), open_now.alias("open_approvals"), "error"
    )
