"""Metric, alert and performance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..fixtures import frame, with_views
from ..functions.scoring import metric_labels
from ..operators import monitoring as m

NOW = "2024-02-09 12:00:00"
THRESHOLDS = {**rules.ALERT_THRESHOLDS, "process": 0.0}


def metrics(sp, sf):
    return frame(sp, sf, "fx_metrics")


def alerts(sp, sf):
    return m.threshold_join(metrics(sp, sf), m.threshold_table(sp, THRESHOLDS))


def states(sp, sf):
    return m.alert_state(alerts(sp, sf), frame(sp, sf, "fx_alert_actions"))


def _labels(sp, sf):
    given = F.from_json("labels_json", "map<string,string>")
    merged = metric_labels(F.col("name"), given)
    return frame(sp, sf, "fx_labelled_metrics").select(
        "seq",
        merged["name"].alias("name"),
        F.try_element_at(merged, F.lit("host")).alias("host"),
        F.size(merged).cast("bigint").alias("labels"),
    )


QUERIES = {
    "threshold_join": alerts,
    "alert_severity": lambda sp, sf: alerts(sp, sf).groupBy("source", "type", "severity").agg(
        F.count("*").alias("alerts"), F.max("value").alias("worst")
    ),
    "metrics_query": lambda sp, sf: m.metrics_query(metrics(sp, sf), "cpu", 100),
    "metrics_query_all": lambda sp, sf: m.metrics_query(metrics(sp, sf), "cpu"),
    "alert_state": states,
    "alerts_query": lambda sp, sf: m.alerts_query(states(sp, sf), limit=100),
    "alerts_query_all": lambda sp, sf: m.alerts_query(states(sp, sf)),
    "retain_recent": lambda sp, sf: m.retain_recent(metrics(sp, sf), F.lit(NOW).cast("timestamp_ntz")),
    "cap_rows": lambda sp, sf: m.cap_rows(metrics(sp, sf), 500),
    "monitor_stats": lambda sp, sf: m.monitor_stats(metrics(sp, sf), states(sp, sf)),
    "performance_state": lambda sp, sf: m.performance_state(frame(sp, sf, "fx_perf_updates")),
    "performance_now": lambda sp, sf: m.performance_now(frame(sp, sf, "fx_perf_updates")),
    "health_status": lambda sp, sf: m.host_health(frame(sp, sf, "fx_heap")),
    "metric_windows": lambda sp, sf: m.metric_windows(metrics(sp, sf)).withColumn(
        "window_start", F.col("window_start").cast("timestamp_ntz")
    ),
    "metric_labels": _labels,
}

METRICS = with_views("fx_metrics")


def alerts_sql(source: str = "fx_metrics") -> str:
    """CTE ``alerts`` over a metric table."""
    limits = ", ".join(f"('{k}', cast({v} as double))" for k, v in THRESHOLDS.items())
    number = "case when value = floor(value) then cast(cast(value as bigint) as varchar) else cast(value as varchar) end"
    return f"""limits(type, threshold) as (values {limits}), alerts as (select seq as alert_id, ts, source,
 case when value > threshold * 1.5 then 'critical' else 'warning' end as severity, concat(m.type, '_high') as type,
 concat(upper(m.type), ' usage is high: ', {number}, unit) as message, value, threshold
 from {source} m join limits l on l.type = m.type where threshold <> 0 and value > threshold)"""


ALERTS = f"{METRICS}, {alerts_sql()}"
STATES = f"""{with_views('fx_metrics', 'fx_alert_actions')}, {alerts_sql()}, folded as (select alert_id,
 bool_or(action = 'acknowledge') as acknowledged,
 arg_max(actor, (ts, seq)) filter (action = 'acknowledge') as acknowledged_by,
 max(ts) filter (action = 'acknowledge') as acknowledged_at,
 bool_or(action = 'resolve') as resolved, max(ts) filter (action = 'resolve') as resolved_at
 from fx_alert_actions group by alert_id),
 states as (select a.*, coalesce(acknowledged, false) as acknowledged, acknowledged_by, acknowledged_at,
 coalesce(resolved, false) as resolved, resolved_at from alerts a left join folded using (alert_id))"""
_LAST = {k: f"last_value({k} ignore nulls) over w" for k in rules.PERFORMANCE_START}

ORACLES = {
    "threshold_join": f"{ALERTS} select * from alerts",
    "alert_severity": f"""{ALERTS} select source, type, severity, count(*) as alerts, max(value) as worst
 from alerts group by source, type, severity""",
    "metrics_query": f"{METRICS} select * from fx_metrics where type = 'cpu' order by seq desc limit 100",
    "metrics_query_all": f"{METRICS} select * from fx_metrics where type = 'cpu'",
    "alerts_query_all": f"{STATES} select * from states where not resolved",
    "alert_state": f"{STATES} select * from states",
    "alerts_query": f"{STATES} select * from states where not resolved order by alert_id desc limit 100",
    "retain_recent": f"{METRICS} select * from fx_metrics where ts > timestamp '{NOW}' - interval 30 day",
    "cap_rows": f"{METRICS} select * from fx_metrics order by ts desc, seq desc limit 500",
    "monitor_stats": f"""{STATES} select (select count(*) from fx_metrics) as total_metrics,
 (select count(*) from states) as total_alerts, (select count(*) from states where not resolved) as active_alerts""",
    "performance_state": f"""{with_views('fx_perf_updates')} select source, seq, ts,
 {', '.join(f"coalesce({e}, {rules.PERFORMANCE_START[k]}::double) as {k}" for k, e in _LAST.items())}
 from fx_perf_updates window w as (partition by source order by ts, seq rows unbounded preceding)""",
    "performance_now": f"""{with_views('fx_perf_updates')} select source,
 {', '.join(f"coalesce(arg_max({k}, (ts, seq)) filter ({k} is not null), {v}::double) as {k}"
            for k, v in rules.PERFORMANCE_START.items())}
 from fx_perf_updates group by source""",
    "health_status": f"""{with_views('fx_heap')} select *, case when heap_bytes > {rules.HEAP_CRITICAL_BYTES} then 'critical'
 when heap_bytes > {rules.HEAP_WARNING_BYTES} then 'warning' else 'healthy' end as status
 from (select source, arg_max(heap_bytes, (ts, seq)) as heap_bytes from fx_heap group by source)""",
    "metric_windows": f"""{METRICS} select time_bucket(interval '30 seconds', ts) as window_start, type,
 round(avg(value), 6) as avg_value, max(value) as max_value, count(*) as samples from fx_metrics group by all""",
    "metric_labels": f"""{with_views('fx_labelled_metrics')} select seq,
 coalesce(json_extract_string(labels_json, '$.name'), name) as name,
 json_extract_string(labels_json, '$.host') as host,
 cast(case when json_extract_string(labels_json, '$.host') is null then 1 else 2 end as bigint) as labels
 from fx_labelled_metrics""",
}
