"""Streaming queries.

Each one runs a stream over a driver table until all of it is processed, into
the shared scratch folder, and returns what the stream wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import VIEWS, derive, frame, table, with_views
from ..operators import deployments as d
from ..operators import monitoring as m
from ..session import configure, scratch_dir
from ..sources.files import read_lines
from ..streaming import jobs, lifecycle, state
from . import deployments as dep
from . import monitoring as mon
from . import secrets as sec

URLS = ["https://hooks.example/a", "https://hooks.example/b"]
DELAY = "1 minute"
TTL = 6 * 3600
CUT, RETENTION = "2024-01-20 00:00:00", 15


def stream(sp, sf, view: str) -> DataFrame:
    """A view over a driver table that is read as a stream of files."""
    configure(sp)
    base = VIEWS[view].base
    schema = table(sp, sf, base).schema
    return derive(jobs.read_table_stream(sp, f"{sf}/{base}.parque[t]", schema), VIEWS[view])


def _written(sp, rows: DataFrame, label: str, mode: str = "append", writer=None) -> DataFrame:
    """Run a stream to its end and read what it wrote."""
    path = scratch_dir(sp, label)
    sink = path if writer is None else writer(path)
    query = jobs.run_available(rows, sink, scratch_dir(sp, f"{label}-checkpoint"), mode)
    query.awaitTermination()
    return sp.read.parquet(path)


def _newest_batch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the states written per micro-batch the last one of every key."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(*keys, "s.*")


def _zoneless(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _stats(sp, sf):
    counts = jobs.stats_stream(stream(sp, sf, "fx_events"))
    return _newest_batch(_written(sp, counts, "stats", "complete", jobs.batch_writer), ["type"])


def _alert_states(sp, sf):
    states = state.alert_state_stream(stream(sp, sf, "fx_alert_actions"))
    newest = _newest_batch(_written(sp, states, "alert-state", "update", jobs.batch_writer), ["alert_id"])
    known = mon.alerts(sp, sf).select("alert_id")
    return _zoneless(newest.join(known, "alert_id", "left_semi"), "acknowledged_at", "resolved_at")


def _deployment_states(sp, sf):
    actions = stream(sp, sf, "fx_approval_actions")
    states = state.deployment_state_stream(actions, dep.requests(sp, sf), d.environment_table(sp))
    return _newest_batch(
        _written(sp, states, "deployment-state", "update", jobs.batch_writer), ["deployment_id"]
    )


def _retained(sp, sf):
    """Metrics in three files, each a batch: the newer rows in two, then the older ones with some of the newer again.

    A batch drops what was late when the batch before it began.
    """
    metrics = frame(sp, sf, "fx_metrics")
    newer = F.col("ts") >= F.lit(CUT).cast("timestamp_ntz")
    path = scratch_dir(sp, "late-metrics")
    for part in (newer & (F.col("seq") % 2 == 0), newer & (F.col("seq") % 2 == 1), ~newer | (F.col("seq") % 7 == 0)):
        metrics.where(part).coalesce(1).write.mode("append").parquet(path)
    rows = jobs.read_table_stream(sp, path, metrics.schema, files_per_trigger=1)
    return _zoneless(_written(sp, jobs.metrics_with_retention(rows, days=RETENTION), "retained"), "ts")


def _alerts(sp, sf):
    return jobs.alert_stream(stream(sp, sf, "fx_metrics"), m.threshold_table(sp, mon.THRESHOLDS))


def _scan_folder(sp, sf):
    """A folder of files of any size as a stream."""
    lines = read_lines(configure(sp), sec.project_folder(sp, sf, "incoming"), include=["**/*.txt"], stream=True)
    return sec.by_project(_written(sp, lines, "scan-folder", writer=jobs.scan_folder_batch)).drop("batch")


def _deployment_lifecycles(sp, sf):
    states = lifecycle.deployment_lifecycle(
        stream(sp, sf, "fx_request_events"), stream(sp, sf, "fx_approval_actions"), d.environment_table(sp)
    )
    return _newest_batch(_written(sp, states, "deployment-life", "update", jobs.batch_writer), ["deployment_id"])


def _alert_lifecycles(sp, sf):
    states = lifecycle.alert_lifecycle(_alerts(sp, sf), stream(sp, sf, "fx_alert_actions"))
    newest = _newest_batch(_written(sp, states, "alert-life", "update", jobs.batch_writer), ["alert_id"])
    return _zoneless(newest, "acknowledged_at", "resolved_at")


def _audit_cache(sp, sf):
    """Which audits are still valid when the stream has come to its end."""
    states = lifecycle.audit_cache(stream(sp, sf, "fx_snapshots"), TTL)
    return _zoneless(_newest_batch(_written(sp, states, "audit-cache", "update", jobs.batch_writer), ["cache_key"]), "fetched_at")


QUERIES = {
    "deployment_lifecycle": _deployment_lifecycles,
    "alert_lifecycle": _alert_lifecycles,
    "audit_cache": _audit_cache,
    "scan_folder_stream": _scan_folder,
    "read_metrics_stream": lambda sp, sf: _written(sp, stream(sp, sf, "fx_metrics"), "metrics"),
    "metrics_with_retention": _retained,
    "alert_stream": lambda sp, sf: _written(sp, _alerts(sp, sf), "alerts"),
    "stats_stream": _stats,
    "metric_window_stream": lambda sp, sf: _zoneless(
        _written(sp, jobs.metric_window_stream(stream(sp, sf, "fx_metrics"), delay=DELAY), "windows"),
        "window_start",
    ),
    "scan_stream": lambda sp, sf: _written(sp, jobs.scan_stream(stream(sp, sf, "fx_planted")), "scan"),
    "notify_stream": lambda sp, sf: _written(
        sp, _alerts(sp, sf), "outbox", writer=lambda path: jobs.notify_batch(URLS, path)
    ).drop("batch"),
    "alert_state_stream": _alert_states,
    "deployment_state_stream": _deployment_states,
}

METRICS = with_views("fx_metrics")
STAMP = "concat(strftime(ts, '%Y-%m-%dT%H:%M:%S.%g'), 'Z')"

ORACLES = {
    "deployment_lifecycle": dep.ORACLES["deployment_state"],
    "alert_lifecycle": f"""{mon.STATES} select alert_id, acknowledged, acknowledged_by, acknowledged_at, resolved, resolved_at from states""",
    "audit_cache": f"""{with_views('fx_snapshots')}, newest as (select cache_key, max((fetched_at, snapshot_id)) as n
 from fx_snapshots group by cache_key)
 select cache_key, n[2] as snapshot_id, n[1] as fetched_at,
 (epoch_us(n[1]) + 999) // 1000 + {TTL} * 1000 > (select epoch_ms(max(fetched_at)) from fx_snapshots) as valid from newest""",
    "scan_folder_stream": sec.ORACLES["scan_folder"],
    "read_metrics_stream": f"{METRICS} select * from fx_metrics",
    "metrics_with_retention": f"""{METRICS} select * from fx_metrics where ts >= timestamp '{CUT}'
 or ts >= (select date_trunc('millisecond', max(ts)) from fx_metrics where ts >= timestamp '{CUT}' and seq % 2 = 0) - interval {RETENTION} day""",
    "alert_stream": f"{mon.ALERTS} select * from alerts",
    "stats_stream": f"{with_views('fx_events')} select type, count(*) as events from fx_events group by type",
    "metric_window_stream": f"""{METRICS} select * from (
 {mon.ORACLES['metric_windows'][len(METRICS):]})
 where window_start + interval '30 seconds' <= (select max(ts) from fx_metrics) - interval '{DELAY}'""",
    "scan_stream": f"{sec.PLANTED} select * from found",
    "notify_stream": f"""{mon.ALERTS} select 'scan' as event, 'monitoring' as package, '1.0.0' as version, ts,
 concat('{{"event":"scan","package":"monitoring","version":"1.0.0","timestamp":"', {STAMP}, '","data":{{"alert":{{"id":', alert_id,
 ',"timestamp":"', {STAMP}, '","resolved":false,"acknowledged":false,"source":"', source, '","severity":"', severity,
 '","type":"', type, '","message":"', message, '","value":', value, ',"threshold":', threshold, '}}}}}}') as payload,
 unnest([{', '.join("'" + u + "'" for u in URLS)}]) as url from alerts""",
    "alert_state_stream": f"""{mon.STATES} select alert_id, acknowledged, acknowledged_by, acknowledged_at, resolved,
 resolved_at from states where alert_id in (select alert_id from fx_alert_actions)""",
    "deployment_state_stream": f"""{dep.APPROVALS}, {dep.VALID}, o as (select deployment_id,
 count(*) filter (status <> 'approved') as open_approvals from (
 select p.deployment_id, case when first_approve is not null and (first_reject is null or first_approve < first_reject)
 then 'approved' else 'pending' end as status from pending p
 left join votes v on v.deployment_id = p.deployment_id and v.approver = p.approver
 left join rejects x on x.deployment_id = p.deployment_id) group by deployment_id)
 select r.deployment_id, case when error is null then coalesce(open_approvals, 0) else 0 end as open_approvals,
 case when error is not null then 'invalid' when x.deployment_id is not null then 'cancelled'
 when coalesce(open_approvals, 0) = 0 then 'approved' else 'pending' end as status, error
 from fx_requests r left join o on o.deployment_id = r.deployment_id
 left join rejects x on x.deployment_id = r.deployment_id left join valid v on v.deployment_id = r.deployment_id
 where r.deployment_id in (select deployment_id from fx_approval_actions)""",
}
