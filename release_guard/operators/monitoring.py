"""Metrics, alerts and performance state."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.scoring import alert_message, alert_severity, health_status
from ..session import small_table
from .ordering import last_n
from .pieces import running


def threshold_table(spark, thresholds: dict[str, float] | None = None) -> DataFrame:
    rows = list((rules.ALERT_THRESHOLDS if thresholds is None else thresholds).items())
    return small_table(spark, {"type": pa.string(), "threshold": pa.float64()}, rows)


def threshold_join(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """One alert per metric above the threshold of its type.

    A threshold of 0 raises nothing, nor does a value that is no number, which Spark
    ranks above all others. The join is on the type alone; Spark
    broadcasts the threshold table as long as it measures small.
    """
    limits = thresholds.filter(F.col("threshold") != 0)
    breaches = metrics.join(limits, "type").filter(
        (F.col("value") > F.col("threshold")) & ~F.isnan("value")
    )
    return breaches.select(
        F.col("seq").alias("alert_id"),
        "ts",
        "source",
        alert_severity(F.col("value"), F.col("threshold")).alias("severity"),
        F.concat("type", F.lit("_high")).alias("type"),
        alert_message(F.col("type"), F.col("value"), F.col("unit")).alias("message"),
        "value",
        "threshold",
    )


def metrics_query(metrics: DataFrame, type: str | None = None, limit: int | None = None) -> DataFrame:
    """Metrics, of one type if given; with a limit the last ones in order of arrival."""
    chosen = metrics if type is None else metrics.filter(F.col("type") == type)
    return chosen if limit is None else last_n(chosen, "seq", limit)


def alerts_query(alerts: DataFrame, resolved: bool = False, limit: int | None = None) -> DataFrame:
    """Open or resolved alerts; with a limit the last ones."""
    chosen = alerts.filter(F.col("resolved") == resolved)
    return chosen if limit is None else last_n(chosen, "alert_id", limit)


def retain_recent(
    metrics: DataFrame, now: Column, days: int = rules.METRIC_RETENTION_DAYS
) -> DataFrame:
    """Metrics strictly younger than the retention."""
    return metrics.filter(F.col("ts") > now - F.make_dt_interval(days=F.lit(days)))


def _reaching(counts: DataFrame, wanted: Column) -> DataFrame:
    """The newest bucket with which the rows from the newest on reach ``wanted``, and the rows after it; no row if none does.

    ``counts(bucket, n)`` has few rows: the years of a history, the days of a year or the minutes of a day.
    """
    listed = F.sort_array(F.collect_list(F.struct("bucket", "n")), asc=False)
    start = F.struct(
        F.lit(None).cast("timestamp_ntz").alias("bucket"), F.lit(0).cast("long").alias("after"), F.lit(0).cast("long").alias("total")
    )

    def step(state: Column, item: Column) -> Column:
        total = state["total"] + item["n"]
        done = state["bucket"].isNotNull()
        here = F.struct(
            F.when(total >= F.col("wanted"), item["bucket"].cast("timestamp_ntz")).alias("bucket"), state["total"].alias("after"), total.alias("total")
        )
        return F.when(done, state).otherwise(here)

    gathered = counts.withColumn("wanted", wanted).agg(listed.alias("listed"), F.max("wanted").alias("wanted"))
    found = gathered.select(F.aggregate("listed", start, step).alias("cut"))
    return found.where("cut.bucket is not null").select("cut.bucket", "cut.after")


def cap_rows(metrics: DataFrame, max_points: int) -> DataFrame:
    """The newest rows up to the capacity of the store.

    Rows are counted per minute. The years, then the days of the year in which the capacity is reached, then the minutes of
    that day tell from where on rows are wanted, so nothing goes through the whole history in one task. Only
    rows from that minute on enter the top-k. Rows without a time are the oldest.
    """
    if max_points <= 0:
        return metrics.limit(0)
    minutes = metrics.groupBy(F.date_trunc("minute", F.col("ts")).cast("timestamp_ntz").alias("minute")).agg(F.count("*").alias("n"))
    wanted: Column = F.lit(max_points)
    inside = minutes.where("minute is not null")
    for unit in ("year", "day", "minute"):
        bucket = F.date_trunc(unit, F.col("minute")).cast("timestamp_ntz")
        cut = _reaching(inside.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")), wanted)
        start, after = cut.select("bucket").scalar(), cut.select("after").scalar()
        inside = inside.where(bucket == start)
        wanted = wanted - after
    recent = metrics.filter((F.date_trunc("minute", F.col("ts")).cast("timestamp_ntz") >= start) | start.isNull())
    return recent.orderBy(F.desc("ts"), F.desc("seq")).limit(max_points)


def monitor_stats(metrics: DataFrame, alerts: DataFrame) -> DataFrame:
    """Totals of metrics, alerts and unresolved alerts in one row."""
    marks = metrics.select(F.lit("metric").alias("kind"), F.lit(True).alias("resolved")).unionByName(
        alerts.select(F.lit("alert").alias("kind"), "resolved")
    )
    is_alert = F.col("kind") == "alert"
    return marks.agg(
        F.count_if(~is_alert).alias("total_metrics"),
        F.count_if(is_alert).alias("total_alerts"),
        F.count_if(is_alert & ~F.col("resolved")).alias("active_alerts"),
    )


def alert_state(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Current state of every alert after its actions.

    Acknowledging and resolving are independent; the last action of a kind
    wins; actions on unknown alerts have no effect.
    """
    order = F.struct("ts", "seq")

    def last(kind: str, field: str) -> Column:
        of_kind = F.col("action") == kind
        return F.max_by(F.when(of_kind, F.col(field)), F.when(of_kind, order))

    folded = actions.groupBy("alert_id").agg(
        F.bool_or(F.col("action") == "acknowledge").alias("acknowledged"),
        last("acknowledge", "actor").alias("acknowledged_by"),
        last("acknowledge", "ts").alias("acknowledged_at"),
        F.bool_or(F.col("action") == "resolve").alias("resolved"),
        last("resolve", "ts").alias("resolved_at"),
    )
    return alerts.join(folded, "alert_id", "left").withColumns(
        {
            "acknowledged": F.coalesce("acknowledged", F.lit(False)),
            "resolved": F.coalesce("resolved", F.lit(False)),
        }
    )


def performance_state(updates: DataFrame, key: str = "source") -> DataFrame:
    """Running state of the performance figures after every partial update.

    A missing figure keeps its last value, starting from fixed values. The updates are gone through in
    pieces of equal size, so a host with very many of them, in one hour too, is spread over tasks.
    """
    fields = list(rules.PERFORMANCE_START)
    carried = running(updates.select(key, "seq", "ts", *fields), [key], ["ts", "seq"], fields)
    return carried.select(
        key, "seq", "ts", *[F.coalesce(f, F.lit(start)).alias(f) for f, start in rules.PERFORMANCE_START.items()]
    )


def performance_now(updates: DataFrame, key: str = "source") -> DataFrame:
    """The state after the last update only: one aggregation."""
    order = F.struct("ts", "seq")
    return updates.groupBy(key).agg(
        *[
            F.coalesce(F.max_by(f, F.when(F.col(f).isNotNull(), order)), F.lit(start)).alias(f)
            for f, start in rules.PERFORMANCE_START.items()
        ]
    )


def host_health(memory: DataFrame) -> DataFrame:
    """Health of every host from its latest heap size."""
    latest = memory.groupBy("source").agg(
        F.max_by("heap_bytes", F.struct("ts", "seq")).alias("heap_bytes")
    )
    return latest.withColumn("status", health_status(F.col("heap_bytes")))


def metric_windows(metrics: DataFrame, interval: str = rules.METRIC_INTERVAL) -> DataFrame:
    """Average, maximum and count per metric type and collection interval."""
    return (
        metrics.groupBy(F.window("ts", interval), "type")
        .agg(
            F.round(F.avg("value"), 6).alias("avg_value"),
            F.max("value").alias("max_value"),
            F.count("*").alias("samples"),
        )
        .select(F.col("window.start").alias("window_start"), "type", "avg_value", "max_value", "samples")
    )


