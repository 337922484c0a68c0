"""Event, usage and log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import frame, with_views
from ..operators import analytics as a
from ..operators import test_runs as t
from ..operators.ordering import last_n, newest_first

TARGET = "pkg-7"


def events(sp, sf):
    return frame(sp, sf, "fx_events")


QUERIES = {
    "event_stats": lambda sp, sf: a.event_stats(events(sp, sf)),
    "dashboard_stats": lambda sp, sf: a.dashboard_stats(events(sp, sf)),
    "user_activity": lambda sp, sf: a.user_activity(events(sp, sf)),
    "event_trend": lambda sp, sf: a.event_trend(events(sp, sf)),
    "publish_size": lambda sp, sf: a.publish_size(
        frame(sp, sf, "fx_files").withColumnRenamed("project_id", "package")
    ),
    "delivery_success_rate": lambda sp, sf: a.delivery_success_rate(frame(sp, sf, "fx_deliveries")),
    "reverse_dependents": lambda sp, sf: a.reverse_dependents(frame(sp, sf, "fx_manifest"), TARGET),
    "dependents_count": lambda sp, sf: a.dependents_count(frame(sp, sf, "fx_manifest")),
    "filter_logs": lambda sp, sf: a.filter_logs(frame(sp, sf, "fx_logs"), "warn"),
    "filter_logs_since": lambda sp, sf: a.filter_logs(
        frame(sp, sf, "fx_deploy_logs"), "error", since="2000-01-01 00:00:00", limit=100, order="seq"
    ).select("deployment_id", "seq", "level", "ts"),
    "last_n": lambda sp, sf: last_n(events(sp, sf), "seq", 10),
    "newest_first": lambda sp, sf: newest_first(frame(sp, sf, "fx_deployments"), 25),
}

EVENTS = with_views("fx_events")


def _found(kind: str, field: str) -> str:
    return f"""coalesce(cast(sum(case when type = '{kind}' then
 cast(json_extract_string(details, '$.{field}') as bigint) end) as bigint), 0)"""


def _last(kind: str) -> str:
    return f"coalesce(strftime(max(ts) filter (type = '{kind}'), '%Y-%m-%d %H:%M:%S'), 'Never')"


ORACLES = {
    "event_stats": f"{EVENTS} select type, count(*) as events, min(seq) as first_seq from fx_events group by type",
    "dashboard_stats": f"""{EVENTS} select count(*) filter (type = 'scan') as total_scans,
 count(*) filter (type = 'publish') as total_publishes, {_found('scan', 'secrets')} as total_secrets_found,
 {_found('audit', 'vulnerabilities')} as total_vulnerabilities,
 {_found('audit', 'licenseIssues')} as total_license_issues,
 {_last('scan')} as last_scan, {_last('publish')} as last_publish from fx_events""",
    "user_activity": f"""{EVENTS} select actor, type, count(*) as events, max(ts) as last_ts
 from fx_events group by actor, type""",
    "event_trend": f"{EVENTS} select cast(ts as date) as day, type, count(*) as events from fx_events group by all",
    "publish_size": f"""{with_views('fx_files')} select project_id as package, count(*) as files,
 cast(sum(size) as bigint) as total_bytes from fx_files group by project_id""",
    "delivery_success_rate": f"""{with_views('fx_deliveries')} select url, count(*) as sent,
 avg(cast(delivered as int)) as success_rate from fx_deliveries group by url""",
    "reverse_dependents": f"""{with_views('fx_manifest')} select distinct name, project_id from fx_manifest
 where name = '{TARGET}'""",
    "dependents_count": f"""{with_views('fx_manifest')} select name, count(distinct project_id) as dependents
 from fx_manifest group by name""",
    "filter_logs": f"{with_views('fx_logs')} select * from fx_logs where level in ('warn', 'error')",
    "filter_logs_since": f"""{with_views('fx_deploy_logs')}, top as (select * from fx_deploy_logs
 where level = 'error' and ts >= timestamp '2000-01-01' order by seq desc limit 100)
 select deployment_id, seq, level, ts from top""",
    "last_n": f"{EVENTS} select * from fx_events order by seq desc limit 10",
    "newest_first": f"{with_views('fx_deployments')} select * from fx_deployments order by seq desc limit 25",
}
