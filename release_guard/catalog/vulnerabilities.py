"""Vulnerability audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..fixtures import frame, with_views
from ..functions.scoring import map_severity
from ..operators import vulnerabilities as v
from ..plans.audits import dependency_audit

NOW = "2024-01-30 12:00:00"
TTL = 4 * 3600
TARGET = "pkg-7"
AUDIT_TIME = "20240131"


def vulns(sp, sf):
    return v.with_mapped_severity(frame(sp, sf, "fx_vulns"))


def projects(sp, sf):
    """All audited projects: those with entries and those of the suppliers."""
    suppliers = frame(sp, sf, "fx_projects").select((-F.col("project_id")).alias("project_id"))
    return vulns(sp, sf).select("project_id").unionByName(suppliers)


def _audit(sp, sf):
    docs = frame(sp, sf, "fx_audit_json").select("project_id", "audit_json")
    return dependency_audit(docs, AUDIT_TIME)


def _members(sp, sf):
    pages = v.package_members(vulns(sp, sf), width=16)
    text = F.transform(
        "items", lambda i: F.concat_ws("/", i["version"], i["severity"], i["fixed_in"], i["advisory_id"])
    )
    return pages.withColumn("items", F.array_join(F.array_sort(text), "; "))


QUERIES = {
    "map_severity": lambda sp, sf: frame(sp, sf, "fx_vulns").select(
        "project_id", "seq", "package", map_severity(F.col("severity")).alias("severity")
    ),
    "filter_vulns_by_severity": lambda sp, sf: v.filter_vulns_by_severity(vulns(sp, sf), "high"),
    "filter_audit_level": lambda sp, sf: v.filter_audit_level(vulns(sp, sf), "moderate"),
    "check_package": lambda sp, sf: v.check_package(vulns(sp, sf), TARGET),
    "check_package_version": lambda sp, sf: v.check_package(vulns(sp, sf), TARGET, "2.0.0"),
    "vuln_summary": lambda sp, sf: v.vuln_summary(vulns(sp, sf)),
    "has_critical": lambda sp, sf: v.has_critical(vulns(sp, sf)),
    "security_score": lambda sp, sf: v.security_scores(v.vuln_summary(vulns(sp, sf))).select(
        "project_id", "score", "band"
    ),
    "group_by_package": lambda sp, sf: v.group_by_package(vulns(sp, sf)),
    "package_members": _members,
    "distinct_packages": lambda sp, sf: v.distinct_packages(vulns(sp, sf)),
    "vuln_recommendations": lambda sp, sf: v.vuln_recommendations(
        vulns(sp, sf), projects=projects(sp, sf)
    ),
    "latest_within_ttl": lambda sp, sf: v.latest_within_ttl(
        frame(sp, sf, "fx_snapshots"), F.lit(NOW).cast("timestamp_ntz"), TTL
    ),
    "dependency_audit": lambda sp, sf: _audit(sp, sf)["summary"],
    "dependency_audit_recommendations": lambda sp, sf: _audit(sp, sf)["recommendations"],
    "dependency_audit_packages": lambda sp, sf: _audit(sp, sf)["packages"],
}

MAP = """case lower(severity) when 'critical' then 'critical' when 'high' then 'high' when 'moderate' then 'moderate'
 when 'medium' then 'moderate' when 'low' then 'low' when 'info' then 'low' else 'moderate' end"""
VULNS = f"{with_views('fx_vulns')}, v as (select * replace ({MAP} as severity) from fx_vulns)"
SUMMARY = """s as (select *, case when critical > 0 then 'critical' when high > 2 then 'high'
 when high > 0 or moderate > 5 then 'moderate' else 'low' end as risk_level from (
 select project_id, count(*) as total, count(*) filter (severity = 'critical') as critical,
 count(*) filter (severity = 'high') as high, count(*) filter (severity = 'moderate') as moderate,
 count(*) filter (severity = 'low') as low from v group by project_id))"""
SCORE = "cast(greatest(0, 100 - 20 * critical - 10 * high - 5 * moderate - low) as bigint)"
BAND = "case when score >= 90 then '🟢' when score >= 70 then '🟡' when score >= 50 then '🟠' else '🔴' end"
PACKAGES = """d as (select project_id, coalesce(fixed_in, '') <> '' as fixable, package, min(seq) as first_seq
 from v group by all)"""
_S = rules.VULN_SENTENCES


def recommendations_sql(projects_sql: str | None) -> str:
    clean = "" if projects_sql is None else f"""
 union all select project_id, 6, 0, '{_S["clean"]}' from (select distinct project_id from ({projects_sql}))
 where project_id not in (select project_id from s)"""
    return f"""r as (
 select project_id, 1 as rec_no, cast(0 as bigint) as page, '{_S["critical"]}' as text from s where critical > 0
 union all select project_id, 2, 0, '{_S["high"]}' from s where high > 0
 union all select project_id, 3, 0, '{_S["moderate"]}' from s where moderate > 0
 union all select project_id, case when fixable then 4 else 5 end, cast(floor(first_seq / 1000) as bigint),
 concat(case when fixable then '{_S["fixable"]}' else '{_S["unfixable"]}' end,
 string_agg(package, ', ' order by first_seq, package)) from d group by project_id, fixable, floor(first_seq / 1000)
 {clean})"""


GROUPED = """select project_id, package, coalesce(arg_min(version, (seq, version)), 'unknown') as version,
 min(seq) as first_seq, count(*) as vulnerabilities from v group by project_id, package"""
AUDIT_DOCS = f"""{with_views('fx_audit_json')}, docs as (select *, row_number() over () as rid from fx_audit_json), a as (
 select rid, project_id, cast(0 as bigint) as seq, package,
 json_extract(audit_json, concat('$.vulnerabilities."', package, '"')) as j from docs
 union all select rid, project_id, 1, 'shared-lib', json_extract(audit_json, '$.vulnerabilities."shared-lib"') from docs)"""
AUDIT = f"""{AUDIT_DOCS},
 b as (select project_id, seq, package, json_extract_string(j, '$.severity') as severity,
 coalesce(json_extract_string(j, '$.version'), 'unknown') as version, json_extract_string(j, '$.fixedIn') as fixed_in
 from a where j is not null), v as (select * replace ({MAP} as severity) from b)"""

ORACLES = {
    "map_severity": f"{VULNS} select project_id, seq, package, severity from v",
    "filter_vulns_by_severity": f"{VULNS} select * from v where severity = 'high'",
    "filter_audit_level": f"{VULNS} select * from v where severity <> 'low'",
    "check_package": f"{VULNS} select * from v where package = '{TARGET}'",
    "check_package_version": f"{VULNS} select * from v where package = '{TARGET}' and version = '2.0.0'",
    "vuln_summary": f"{VULNS}, {SUMMARY} select * from s",
    "has_critical": f"""{VULNS} select project_id, bool_or(severity in ('critical', 'high')) as has_critical
 from v group by project_id""",
    "security_score": f"""{VULNS}, {SUMMARY} select *, {BAND} as band
 from (select project_id, {SCORE} as score from s)""",
    "group_by_package": f"{VULNS} {GROUPED}",
    "package_members": f"""{VULNS}, t as (select project_id, package, cast(floor(seq / 16) as bigint) as page,
 concat_ws('/', version, severity, fixed_in, advisory_id) as item from v)
 select project_id, package, page, count(*) as n, string_agg(item, '; ' order by item) as items from t group by all""",
    "distinct_packages": f"{VULNS}, {PACKAGES} select * from d",
    "vuln_recommendations": f"""{with_views('fx_vulns', 'fx_projects')},
 v as (select * replace ({MAP} as severity) from fx_vulns), {SUMMARY}, {PACKAGES},
 {recommendations_sql("select project_id from v union all select -project_id from fx_projects")} select * from r""",
    "latest_within_ttl": f"""{with_views('fx_snapshots')} select cache_key, snapshot_id, fetched_at from fx_snapshots
 qualify row_number() over (partition by cache_key order by fetched_at desc, snapshot_id desc) = 1
 and timestamp '{NOW}' - fetched_at < interval '{TTL}' second""",
    "dependency_audit": f"""{AUDIT}, {SUMMARY} select *, {BAND} as band from (select *, {SCORE} as score from s)""",
    "dependency_audit_recommendations": f"""{AUDIT}, {SUMMARY}, {PACKAGES},
 {recommendations_sql("select project_id from fx_audit_json")} select * from r""",
    "dependency_audit_packages": f"{AUDIT} {GROUPED}",
}
