"""Counts over the event history and the outbox."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import label_map


def event_stats(events: DataFrame) -> DataFrame:
    """Count per event type in order of first appearance."""
    return (
        events.groupBy("type")
        .agg(F.count("*").alias("events"), F.min("seq").alias("first_seq"))
        .orderBy("first_seq")
    )


def event_report(events: DataFrame) -> DataFrame:
    """The lines of the event report: one per type, then the total."""
    icon = F.coalesce(label_map(rules.EVENT_ICONS, F.col("type")), F.lit(rules.EVENT_ICON_DEFAULT))
    grouped = (
        events.rollup("type")
        .agg(
            F.grouping("type").alias("is_total"),
            F.count("*").alias("n"),
            F.min("seq").alias("first_seq"),
        )
        .withColumn("n", F.col("n").cast("string"))
    )
    text = F.when(F.col("is_total") == 1, F.concat(F.lit("Total events: "), "n")).otherwise(
        F.concat(icon, F.lit(" "), "type", F.lit(": "), "n")
    )
    return grouped.select("is_total", "first_seq", text.alias("text"))


def dashboard_stats(events: DataFrame) -> DataFrame:
    """One row of totals; numbers found are read from the details of the events."""

    def total(kind: str, field: str):
        found = F.get_json_object("details", f"$.{field}").try_cast("bigint")
        return F.coalesce(F.sum(F.when(F.col("type") == kind, found)), F.lit(0))

    def last(kind: str):
        stamp = F.date_format(F.max(F.when(F.col("type") == kind, F.col("ts"))), "yyyy-MM-dd HH:mm:ss")
        return F.coalesce(stamp, F.lit("Never"))

    return events.agg(
        F.count_if(F.col("type") == "scan").alias("total_scans"),
        F.count_if(F.col("type") == "publish").alias("total_publishes"),
        total("scan", "secrets").alias("total_secrets_found"),
        total("audit", "vulnerabilities").alias("total_vulnerabilities"),
        total("audit", "licenseIssues").alias("total_license_issues"),
        last("scan").alias("last_scan"),
        last("publish").alias("last_publish"),
    )


def user_activity(events: DataFrame) -> DataFrame:
    """Count and last time per user and event type."""
    return events.groupBy("actor", "type").agg(
        F.count("*").alias("events"), F.max("ts").alias("last_ts")
    )


def event_trend(events: DataFrame) -> DataFrame:
    """Count per day and event type."""
    return events.groupBy(F.to_date("ts").alias("day"), "type").agg(F.count("*").alias("events"))


def publish_size(files: DataFrame) -> DataFrame:
    """Number and bytes of files per package."""
    return files.groupBy("package").agg(
        F.count("*").alias("files"), F.sum("size").alias("total_bytes")
    )


def delivery_success_rate(outbox: DataFrame) -> DataFrame:
    """Delivered share per webhook."""
    return outbox.groupBy("url").agg(
        F.count("*").alias("sent"), F.avg(F.col("delivered").cast("int")).alias("success_rate")
    )


def reverse_dependents(deps: DataFrame, target: str | None = None) -> DataFrame:
    """Which projects depend on a package (all packages unless one is named)."""
    chosen = deps if target is None else deps.filter(F.col("name") == target)
    return chosen.select("name", "project_id").distinct()


def dependents_count(deps: DataFrame) -> DataFrame:
    """Number of projects that depend on each package.

    The pairs are made distinct first, so a popular package is counted from
    many tasks and not in one.
    """
    return reverse_dependents(deps).groupBy("name").agg(F.count("*").alias("dependents"))


def filter_logs(
    logs: DataFrame, level: str, since: str | None = None, limit: int | None = None,
    order: str = "seq",
) -> DataFrame:
    """Log rows of at least a level; ``silent`` lets nothing through."""
    floor = rules.LOG_LEVEL_RANK[level]
    wanted = [x for x, rank in rules.LOG_LEVEL_RANK.items() if rank >= floor and x != "silent"]
    kept = logs.filter(F.col("level").isin(wanted))
    if since is not None:
        kept = kept.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    if limit is not None:
        kept = kept.orderBy(F.desc(order)).limit(limit).orderBy(order)
    return kept
