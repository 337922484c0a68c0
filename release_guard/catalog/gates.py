"""Gate, workflow and risk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import frame, with_views
from ..operators import secrets as s
from ..operators.versions import version_bump
from ..plans import gates as g
from ..plans.scan import run_publish, secret_scan
from . import licenses as lic
from . import secrets as sec
from . import versions as ver
from . import vulnerabilities as vul

TOKEN = "High Entropy String"


def _findings(sp, sf):
    return sec.scan_inputs(sp, sf)


def _projects(sp, sf):
    return frame(sp, sf, "fx_projects")


def _gate(sp, sf):
    return g.publish_gate(
        _projects(sp, sf), _findings(sp, sf), frame(sp, sf, "fx_git"), frame(sp, sf, "fx_ci")
    )


def _bumps(sp, sf):
    bumps = version_bump(frame(sp, sf, "fx_small_commits"))
    return bumps.withColumn("project_id", F.replace(F.col("repo"), F.lit("app-"), F.lit("")).cast("bigint"))


def _warnings(sp, sf):
    files = frame(sp, sf, "fx_files").withColumn("size", F.col("size") * 300)
    deps = frame(sp, sf, "fx_manifest").withColumn("project_id", F.col("project_id") % 200)
    tokens = _findings(sp, sf).filter(F.col("pattern_name") == TOKEN)
    warned = g.publish_warnings(files, deps, _bumps(sp, sf), tokens)
    return warned.withColumn("warnings", F.array_join("warnings", "; "))


def _diff_by_project(sp, sf):
    return s.secret_diff_summary(sec.diff(sp, sf), ["project_id"])


def _hooked(sp, sf):
    """A scan that a user narrows before and after with functions of their own."""
    return secret_scan(
        sec._planted(sp, sf),
        pre_scan=lambda files: files.filter(F.col("project_id") != 3),
        post_scan=lambda found: found.filter(F.col("severity") != "low").withColumn("team", F.lit("core")),
    ).select("file", "line", "column", "severity", "team")


def _publish(sp, sf):
    return run_publish(
        frame(sp, sf, "fx_git"),
        pre_publish=lambda p: p.withColumn("passed", F.col("is_clean")),
        post_publish=lambda p: p.withColumn("event", F.lit("publish")),
    )


QUERIES = {
    "publish_gate": _gate,
    "publish_warnings": _warnings,
    "security_workflow": lambda sp, sf: g.security_workflow(
        _projects(sp, sf), _findings(sp, sf), lic.packages(sp, sf), vul.vulns(sp, sf)
    ),
    "unpublish_impact": lambda sp, sf: g.unpublish_impact(
        frame(sp, sf, "fx_manifest"), frame(sp, sf, "fx_downloads")
    ),
    "overall_risk": lambda sp, sf: g.overall_risk(
        sec.scan_planted(sp, sf), _diff_by_project(sp, sf), lic.packages(sp, sf), vul.vulns(sp, sf)
    ),
    "scan_hooks": _hooked,
    "publish_hooks": _publish,
}

WORK = f"""{with_views('fx_files', 'fx_planted', 'fx_projects', 'fx_git', 'fx_ci', 'fx_vulns', 'fx_manifest', 'fx_installed')},
 {sec.INPUTS}, {sec.scan_sql('inputs', 'found')},
 c as (select project_id, count(*) as secrets from found group by project_id)"""
LICENSE_CTES = f"{lic.MERGED}, {lic.packages_sql('merged', repr(lic.PROJECT), lic.ALLOWED, lic.BLOCKED)}"
BAD = "bad as (select project_id, count(*) filter (not compatible) as incompatible from p group by project_id)"
VULN_CTES = f"v as (select * replace ({vul.MAP} as severity) from fx_vulns), {vul.SUMMARY}"

ORACLES = {
    "publish_gate": f"""{WORK} select *, git_status and secret_scan and ci_status as all_passed from (
 select project_id, coalesce(is_clean, false) as git_status, coalesce(secrets, 0) = 0 as secret_scan,
 coalesce(is_passing, false) as ci_status
 from (select project_id from fx_projects union select project_id from found union select project_id from fx_git
 union select project_id from fx_ci) left join fx_git using (project_id) left join fx_ci using (project_id)
 left join c using (project_id))""",
    "publish_warnings": f"""{with_views('fx_files', 'fx_planted', 'fx_manifest', 'fx_small_commits')}, {sec.INPUTS},
 {sec.scan_sql('inputs', 'found')},
 src as (select * from fx_small_commits), {ver.PARSED}, {ver.BUMPS},
 facts as (select project_id, 'b' as k, sum(size * 300) as n from fx_files group by project_id
 union all select project_id % 200, 'd', count(*) from fx_manifest group by all
 union all select cast(replace(repo, 'app-', '') as bigint), 'm', case when recommended_bump = 'major' then 1 else 0 end from bumps
 union all select project_id, 't', count(*) from found where pattern_name = '{TOKEN}' group by project_id),
 wide as (select project_id, coalesce(sum(n) filter (k = 'b'), 0) as b, coalesce(sum(n) filter (k = 'd'), 0) as d,
 coalesce(sum(n) filter (k = 'm'), 0) as m, coalesce(sum(n) filter (k = 't'), 0) as t from facts group by project_id)
 select project_id, array_to_string(list_filter([case when b > 10485760 then 'Large package size' end,
 case when d > 100 then 'Many dependencies' end, case when m > 0 then 'Breaking changes' end,
 case when t > 0 then 'High entropy strings' end], lambda x: x is not null), '; ') as warnings from wide""",
    "security_workflow": f"""{WORK}, {LICENSE_CTES}, {BAD}, {VULN_CTES}
 select *, incompatible > 0 or critical > 0 or high > 0 as has_issues from (
 select project_id, coalesce(secrets, 0) as secrets, coalesce(secrets, 0) > 0 as stopped,
 case when coalesce(secrets, 0) = 0 then coalesce(incompatible, 0) end as incompatible,
 case when coalesce(secrets, 0) = 0 then coalesce(critical, 0) end as critical,
 case when coalesce(secrets, 0) = 0 then coalesce(high, 0) end as high
 from (select project_id from fx_projects union select project_id from c union select project_id from p
 union select project_id from s) left join c using (project_id) left join bad using (project_id) left join s using (project_id))""",
    "unpublish_impact": f"""{with_views('fx_manifest', 'fx_downloads')}, d as (select name,
 count(distinct project_id) as dependents from fx_manifest group by name), l as (select name,
 cast(sum(downloads) as bigint) as downloads from fx_downloads group by name),
 j as (select name, coalesce(downloads, 0) as downloads, coalesce(dependents, 0) as dependents from l full join d using (name))
 select *, case when dependents > 100 or downloads > 1000000 then 'critical' when dependents > 50 or downloads > 100000
 then 'high' when dependents > 0 then 'medium' else 'low' end as risk_level,
 case when dependents > 0 then 'This version has active dependents' end as warning from j""",
    "overall_risk": f"""{with_views('fx_planted', 'fx_planted_before', 'fx_manifest', 'fx_installed', 'fx_vulns')},
 {sec.scan_sql('fx_planted', 'cur')}, {sec.scan_sql('fx_planted_before', 'old')},
 diff as (select cast(string_split(file, '/')[2] as bigint) % 60 as project_id,
 coalesce(cur.severity, old.severity) as severity, case when old.value is null then 'added'
 when cur.value is null then 'removed' when cur.value <> old.value then 'modified' else 'unchanged' end as change
 from cur full join old using (file, line, "column", pattern_name)),
 dr as (select project_id, case when count(*) filter (change = 'added' and severity = 'critical') > 0 then 3
 when count(*) filter (change = 'added' and severity = 'high') > 0 then 2 else 0 end as diff_points
 from diff group by project_id),
 c as (select project_id, count(*) as secrets from cur group by project_id), {LICENSE_CTES}, {BAD}, {VULN_CTES}
 select *, case when points >= 6 then 'critical' when points >= 4 then 'high' when points >= 2 then 'medium'
 else 'low' end as risk_level from (select project_id, cast(case when coalesce(secrets, 0) > 0 then 3 else 0 end
 + coalesce(diff_points, 0) + case when coalesce(incompatible, 0) > 0 then 1 else 0 end
 + case when coalesce(critical, 0) > 0 then 3 else 0 end + case when coalesce(high, 0) > 0 then 2 else 0 end
 + case when coalesce(moderate, 0) > 0 then 1 else 0 end as int) as points
 from s full join c using (project_id) full join dr using (project_id) full join bad using (project_id))""",
    "scan_hooks": f"""{sec.PLANTED} select file, line, "column", severity, 'core' as team from found
 where severity <> 'low' and project_id <> 3""",
    "publish_hooks": f"{with_views('fx_git')} select *, 'publish' as event from fx_git where is_clean",
}
