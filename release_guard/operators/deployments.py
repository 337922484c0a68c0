"""Deployment requests, approvals, listings and rollbacks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.scoring import duration_ms
from ..session import small_table
from .ordering import newest_first, top_per_group


def environment_table(spark) -> DataFrame:
    columns = {
        "name": pa.string(),
        "type": pa.string(),
        "deployment_strategy": pa.string(),
        "auto_approve": pa.bool_(),
        "required_approvers": pa.list_(pa.string()),
    }
    return small_table(spark, columns, rules.ENVIRONMENTS)


def strategy_table(spark) -> DataFrame:
    return small_table(spark, {"name": pa.string()}, [(s,) for s in rules.STRATEGIES])


def upsert_environments(current: DataFrame, updates: DataFrame) -> DataFrame:
    """The environments after changes applied in the order of ``seq``.

    ``updates`` has the columns of ``current`` plus ``seq`` and ``op``. ``add`` always adds one, also beside one of the
    same name; ``update`` overwrites the given fields of the first environment of its name, and gives a row with an error
    if there is none at that moment. ``added_by`` is the ``seq`` that added a row, or that failed; null for
    those of ``current``, whose names differ. Every field takes its last given value by one aggregation per name.
    """
    fields = [c for c in current.columns if c != "name"]
    kept = [F.col(f) for f in fields]
    adds = updates.where("op = 'add'").select("name", F.col("seq").alias("added_by"), *kept)
    every = adds.unionByName(current.select("name", F.lit(None).cast(updates.schema["seq"].dataType).alias("added_by"), *kept))
    # A null sorts before all numbers: what was there is first.
    first = every.groupBy("name").agg(F.min(F.struct(F.col("added_by").isNotNull().alias("late"), "added_by")).alias("first"))
    changes = updates.where("op = 'update'").join(first, "name", "left")
    there = F.col("first").isNotNull() & (~F.col("first.late") | (F.col("seq") > F.col("first.added_by")))
    given = changes.where(there).groupBy("name").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"new_{f}") for f in fields]
    )
    is_first = F.col("added_by").eqNullSafe(F.col("first.added_by"))
    merged = every.join(first, "name").join(given, "name", "left").select(
        "name", "added_by", *[F.when(is_first, F.coalesce(f"new_{f}", f)).otherwise(F.col(f)).alias(f) for f in fields],
        F.lit(None).cast("string").alias("error"),
    )
    missing = changes.where(~there).select(
        "name", F.col("seq").alias("added_by"), *kept, F.concat(F.lit("Environment '"), "name", F.lit("' not found")).alias("error")
    )
    return merged.unionByName(missing)


def validate_requests(
    requests: DataFrame, environments: DataFrame, strategies: DataFrame
) -> DataFrame:
    """Resolve the strategy of each request; an unknown name gives an error text."""
    env = environments.select(
        F.col("name").alias("environment"),
        F.col("deployment_strategy").alias("default_strategy"),
        F.lit(True).alias("env_known"),
    )
    known = strategies.select(F.col("name").alias("strategy"), F.lit(True).alias("strategy_known"))
    chosen = F.coalesce(F.nullif(F.col("strategy"), F.lit("")), "default_strategy")
    resolved = (
        requests.join(env, "environment", "left")
        .withColumn("strategy", chosen)
        .join(known, "strategy", "left")
    )
    error = F.when(
        F.col("env_known").isNull(),
        F.concat(F.lit("Environment '"), "environment", F.lit("' not found")),
    ).when(
        F.col("strategy_known").isNull(),
        F.concat(F.lit("Deployment strategy '"), "strategy", F.lit("' not found")),
    )
    return resolved.withColumn("error", error).drop("default_strategy", "env_known", "strategy_known")


def pending_approvals(requests: DataFrame, environments: DataFrame) -> DataFrame:
    """One pending row per required approver, none where approval is automatic."""
    env = environments.select(
        F.col("name").alias("environment"),
        F.col("auto_approve").alias("env_auto"),
        F.explode("required_approvers").alias("approver"),
    )
    automatic = F.coalesce("env_auto", F.lit(False)) | F.coalesce("auto_approve", F.lit(False))
    return (
        requests.join(env, "environment")
        .filter(~automatic)
        .select("deployment_id", "environment", "approver", F.lit("pending").alias("status"))
    )


def approval_state(pending: DataFrame, actions: DataFrame) -> DataFrame:
    """Status of every required approval after the actions.

    Approvals that come after the first rejection of a deployment are ignored,
    because only a pending deployment may be approved.
    """
    order = F.struct("ts", "seq")
    is_reject = F.col("action") == "reject"
    rejections = actions.groupBy("deployment_id").agg(
        F.min(F.when(is_reject, order)).alias("first_reject")
    )
    votes = actions.groupBy("deployment_id", "approver").agg(
        F.min(F.when(F.col("action") == "approve", order)).alias("first_approve"),
        F.bool_or(is_reject).alias("rejected"),
    )
    in_time = F.col("first_approve").isNotNull() & (
        F.col("first_reject").isNull() | (F.col("first_approve") < F.col("first_reject"))
    )
    status = F.when(F.col("rejected"), "rejected").when(in_time, "approved").otherwise("pending")
    return (
        pending.select("deployment_id", "environment", "approver")
        .join(votes, ["deployment_id", "approver"], "left")
        .join(rejections, "deployment_id", "left")
        .select("deployment_id", "environment", "approver", status.alias("status"))
    )


def deployment_state(
    requests: DataFrame, environments: DataFrame, actions: DataFrame, strategies: DataFrame | None = None
) -> DataFrame:
    """Where each deployment stands: invalid, cancelled, approved or pending.

    A request for an unknown environment or strategy is invalid and gets the error
    text. Any rejection cancels. Without one, a deployment is approved once no required approval
    is pending; one that needs no approval is approved. The actions are combined
    once per deployment and approver; of approvers nobody asks for only rejections count.
    """
    strategies = strategy_table(requests.sparkSession) if strategies is None else strategies
    order = F.struct("ts", "seq")
    votes = actions.groupBy("deployment_id", "approver").agg(
        F.min(F.when(F.col("action") == "approve", order)).alias("approved"),
        F.min(F.when(F.col("action") == "reject", order)).alias("rejected"),
    )
    asked = environments.select(F.explode("required_approvers").alias("approver")).distinct()
    votes = votes.join(asked.withColumn("asked", F.lit(True)), "approver", "left")
    # The votes of those some environment asks, a few for each deployment.
    folded = votes.groupBy("deployment_id").agg(
        F.min("rejected").alias("first_reject"),
        F.collect_list(F.when(F.col("asked"), F.struct("approver", "approved", "rejected"))).alias("votes"),
    )
    valid = validate_requests(requests, environments, strategies).drop("strategy")
    required = valid.join(required_approvals(requests, environments), "deployment_id")
    joined = required.join(folded, "deployment_id", "left")

    def settled(vote: Column) -> Column:
        first = F.col("first_reject")
        in_time = vote["approved"].isNotNull() & (first.isNull() | (vote["approved"] < first))
        return vote["rejected"].isNotNull() | in_time

    done = F.transform(F.filter("votes", settled), lambda v: v["approver"])
    nobody = F.array().cast("array<string>")
    still_open = F.size(F.array_except("required", F.coalesce(done, nobody)))
    open_now = F.when(F.col("error").isNull(), still_open).otherwise(0).cast("bigint")
    status = (
        F.when(F.col("error").isNotNull(), "invalid")
        .when(F.col("first_reject").isNotNull(), "cancelled")
        .when(open_now == 0, "approved")
        .otherwise("pending")
    )
    return joined.select("deployment_id", "environment", open_now.alias("open_approvals"), status.alias("status"), "error")


def required_approvals(requests: DataFrame, environments: DataFrame) -> DataFrame:
    """Who has to approve each deployment; nobody where approval is automatic."""
    nobody = F.array().cast("array<string>")
    env = environments.select(
        F.col("name").alias("environment"), F.col("auto_approve").alias("env_auto"), "required_approvers"
    )
    automatic = F.coalesce("env_auto", F.lit(False)) | F.coalesce("auto_approve", F.lit(False))
    return requests.join(env, "environment", "left").select(
        "deployment_id",
        F.when(automatic, nobody).otherwise(F.coalesce("required_approvers", nobody)).alias("required"),
    )


def deployments_query(
    df: DataFrame, environment: str | None = None, status: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Filtered deployments: the last ones by arrival, newest first."""
    chosen = df
    if environment is not None:
        chosen = chosen.filter(F.col("environment") == environment)
    if status is not None:
        chosen = chosen.filter(F.col("status") == status)
    return newest_first(chosen, limit)


def deployment_by_id(df: DataFrame, wanted: DataFrame, key: str = "seq") -> DataFrame:
    """The deployments with these ids; unknown ids give no row."""
    return df.join(wanted.select(key), key, "left_semi")


def rollback_target(deployments: DataFrame) -> DataFrame:
    """Per environment the second most recent success."""
    successes = deployments.filter(F.col("status") == "success")
    ranked = top_per_group(
        successes, ["environment"], [F.desc("completed_at"), F.desc("seq")], 2
    )
    return ranked.filter(F.col("rn") == 2).drop("rn")


def success_rate(deployments: DataFrame) -> DataFrame:
    """Successes among finished deployments per environment."""
    finished = deployments.filter(F.col("completed_at").isNotNull())
    return finished.groupBy("environment").agg(
        F.count("*").alias("finished"),
        F.avg(F.when(F.col("status") == "success", 1).otherwise(0)).alias("success_rate"),
    )


def deployment_durations(deployments: DataFrame) -> DataFrame:
    return deployments.withColumn(
        "duration_ms", duration_ms(F.col("created_at"), F.col("completed_at"))
    )


def first_errors(logs: DataFrame, n: int) -> DataFrame:
    """Per deployment its first n errors as one text, with a mark if there are more."""
    errors = top_per_group(
        logs.filter(F.col("level") == "error"), ["deployment_id"], [F.asc("ts"), F.asc("seq")], n + 1
    )
    shown = F.array_sort(F.collect_list(F.when(F.col("rn") <= n, F.struct("rn", "message"))))
    return errors.groupBy("deployment_id").agg(
        F.concat(
            F.array_join(F.transform(shown, lambda e: e["message"]), "\n"),
            F.when(F.max("rn") > n, "\n...").otherwise(""),
        ).alias("errors")
    )


def last_logs(logs: DataFrame, n: int) -> DataFrame:
    """Per deployment its last n log lines in order."""
    latest = top_per_group(logs, ["deployment_id"], [F.desc("ts"), F.desc("seq")], n)
    lines = F.array_sort(F.collect_list(F.struct((-F.col("rn")).alias("at"), "message")))
    return latest.groupBy("deployment_id").agg(
        F.array_join(F.transform(lines, lambda e: e["message"]), "\n").alias("recent")
    )
