"""Tracker issue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..fixtures import frame, with_views
from ..functions.scoring import severity_to_priority
from ..operators import issues as i
from ..operators import vulnerabilities as v
from ..sources.manifests import parse_audit_json
from . import licenses as lic
from . import secrets as sec
from . import sources as src
from . import vulnerabilities as vul

TRACKER = "linear"


def _labels(df):
    return df.withColumn("labels", F.array_join("labels", ","))


def _search(sp, sf):
    issues = frame(sp, sf, "fx_issues").withColumn("labels", F.array("label"))
    return i.search_issues(issues, "security", 50).drop("labels")


def _security(sp, sf):
    """One issue per vulnerability; "moderate" is "medium" for a tracker."""
    severity = F.when(F.col("severity") == "moderate", "medium").otherwise(F.col("severity"))
    problems = vul.vulns(sp, sf).select(
        "project_id", "seq", "package", "version",
        F.concat(F.lit("Vulnerability in "), "package").alias("title"),
        F.lit(rules.NO_DESCRIPTION).alias("description"),
        severity.alias("severity"),
        F.when(F.col("seq") % 2 == 0, 7.5).when(F.col("seq") % 3 == 0, 9.0).alias("cvss"),
        F.when(F.col("seq") % 4 == 0, F.concat(F.lit("CVE-"), F.col("advisory_id").cast("string"))).alias("cve"),
        F.when(
            F.col("fixed_in").isNotNull(), F.concat(F.lit("Update to "), "fixed_in")
        ).alias("recommendation"),
    )
    return _labels(i.security_issues(problems, ["project_id", "seq", "package"], "jira"))


def _finding_issues(sp, sf):
    problems = sec.scan_planted(sp, sf).select(
        "project_id", "file", "line", "column", "severity",
        F.col("pattern_name").alias("title"),
        F.lit("Secret found").alias("description"),
    )
    return _labels(i.security_issues(problems, ["file", "line", "column"], TRACKER))


QUERIES = {
    "search_issues": _search,
    "match_labels": lambda sp, sf: i.match_labels(
        frame(sp, sf, "fx_label_requests"), frame(sp, sf, "fx_label_list")
    ),
    "severity_to_priority": lambda sp, sf: sec.scan_inputs(sp, sf).select(
        "file", "line", "column",
        severity_to_priority(F.col("severity"), "linear").alias("linear"),
        severity_to_priority(F.col("severity"), "jira").alias("jira"),
    ),
    "issue_payloads": _security,
    "finding_issues": _finding_issues,
    "secret_issues": lambda sp, sf: _labels(i.secret_issues(sec.scan_planted(sp, sf), TRACKER)),
    "audit_priority": lambda sp, sf: _labels(i.dependency_issues(vul.vulns(sp, sf), "jira")),
    "dependency_issue_lists": lambda sp, sf: i.dependency_issue_lists(vul.vulns(sp, sf), width=16),
    "issue_recommendations": lambda sp, sf: i.issue_recommendations(
        v.vuln_recommendations(vul.vulns(sp, sf)), i.dependency_issues(vul.vulns(sp, sf), "jira")
    ),
    "audit_issue_lists": lambda sp, sf: i.dependency_issue_lists(
        parse_audit_json(frame(sp, sf, "fx_audit_json").select("project_id", "audit_json"), vul.AUDIT_TIME), width=16
    ),
    "license_issues": lambda sp, sf: _labels(i.license_issues(lic.packages(sp, sf), TRACKER)),
    "license_issue_lists": lambda sp, sf: i.license_issue_lists(lic.packages(sp, sf), width=100),
}

END = "chr(10) || '---' || chr(10) || '*Issue created by release-guard "


def _line(label: str, value: str) -> str:
    return f"case when coalesce({value}, '') <> '' then concat('**{label}:** ', {value}, chr(10)) else '' end"


PRIORITY = "case severity when 'critical' then '{top}' when 'high' then 'High' when 'medium' then 'Medium' when 'low' then 'Low' end"
LINEAR, JIRA = PRIORITY.format(top="Urgent"), PRIORITY.format(top="Highest")

ORACLES = {
    "search_issues": f"""{with_views('fx_issues')} select * from fx_issues where label = 'security'
 order by case priority when 'Urgent' then 4 when 'High' then 3 when 'Medium' then 2 when 'Low' then 1 else 0 end desc,
 created_at desc, issue_id desc limit 50""",
    "match_labels": f"""{with_views('fx_label_requests', 'fx_label_list')} select r.*, l.label_id
 from fx_label_requests r join (select lower(name) as k, arg_min(label_id, pos) as label_id from fx_label_list
 group by lower(name)) l on l.k = lower(r.name)""",
    "severity_to_priority": f"""{sec.FOUND_ALL} select file, line, "column", {LINEAR} as linear, {JIRA} as jira
 from found""",
    "issue_payloads": f"""{vul.VULNS}, p as (select * replace (case severity when 'moderate' then 'medium' else severity end as severity),
 case when seq % 2 = 0 then '7.5' when seq % 3 = 0 then '9' end as cvss,
 case when seq % 4 = 0 then concat('CVE-', advisory_id) end as cve from v)
 select project_id, seq, package, 'security' as kind, concat('[Security] Vulnerability in ', package) as title,
 concat('{rules.NO_DESCRIPTION}', chr(10), chr(10), {_line('Package', 'package')}, {_line('Version', 'version')},
 {_line('CVE', 'cve')}, {_line('CVSS Score', 'cvss')},
 case when fixed_in is not null then concat(chr(10), '**Recommendation:** Update to ', fixed_in, chr(10)) else '' end,
 {END}Security Scanner*') as description, 'Bug' as issue_type, {JIRA} as priority,
 'security,vulnerability,release-guard' as labels from p""",
    "finding_issues": f"""{sec.PLANTED} select file, line, "column", 'security' as kind,
 concat('[Security] ', pattern_name) as title,
 concat('Secret found', chr(10), chr(10), '**File:** ', file, ':', line, chr(10), {END}Security Scanner*') as description,
 'Bug' as issue_type, {LINEAR} as priority, 'security,vulnerability,release-guard' as labels from found""",
    "secret_issues": f"""{sec.PLANTED} select project_id, 'security' as kind,
 '[Security] Secrets detected in source code' as title,
 concat('Found ', count(*), ' potential secrets during scan.', chr(10), chr(10), chr(10),
 '**Recommendation:** Remove secrets and use environment variables', chr(10), {END}Security Scanner*') as description,
 'Bug' as issue_type, 'Urgent' as priority, 'security,vulnerability,release-guard' as labels
 from found group by project_id""",
    "audit_priority": f"""{vul.VULNS}, {vul.SUMMARY}, t as (select *, concat(critical, ' critical and ', high,
 ' high vulnerabilities found') as text from s where critical > 0 or high > 0)
 select project_id, 'dependency' as kind, concat('[Dependency Audit] ', text) as title,
 concat(text, chr(10), {END}Dependency Auditor*') as description, 'Task' as issue_type,
 case when critical > 0 then 'Highest' else 'High' end as priority, 'dependency,audit,release-guard' as labels from t""",
    "dependency_issue_lists": f"""{vul.VULNS}, t as (select project_id, seq, concat('• ', package, '@', version, ' - ',
 upper(severity), ': Vulnerability in ', package, chr(10),
 case when fixed_in is not null then concat('  Fixed in: ', fixed_in, chr(10)) else '' end) as item
 from v where severity in ('critical', 'high'))
 select project_id, cast(floor(seq / 16) as bigint) as page,
 concat('**Vulnerabilities Found:**', chr(10), string_agg(item, '' order by seq, item)) as text from t group by all""",
    "issue_recommendations": f"""{vul.VULNS}, {vul.SUMMARY}, {vul.PACKAGES}, {vul.recommendations_sql(None)}
 select project_id, rec_no, page, concat('• ', text, chr(10)) as text from r
 where project_id in (select project_id from s where critical > 0 or high > 0)""",
    "audit_issue_lists": f"""with v as ({src.ORACLES['parse_audit_json']}), t as (select project_id, seq, concat('• ', package, '@',
 version, ' - ', upper(severity), ': ', title, chr(10),
 case when coalesce(fixed_in, '') <> '' then concat('  Fixed in: ', fixed_in, chr(10)) else '' end) as item
 from v where severity in ('critical', 'high'))
 select project_id, cast(floor(seq / 16) as bigint) as page,
 concat('**Vulnerabilities Found:**', chr(10), string_agg(item, '' order by seq, item)) as text from t group by all""",
    "license_issues": f"""{lic.PACKAGES}, {lic.SUMMARY}, t as (select *,
 concat(incompatible, ' packages have incompatible licenses') as text from s where incompatible > 0)
 select project_id, 'license' as kind, concat('[License Compliance] ', text) as title,
 concat(text, chr(10), {END}License Checker*') as description, 'Task' as issue_type, 'High' as priority,
 'license,compliance,release-guard' as labels from t""",
    "license_issue_lists": f"""{lic.PACKAGES}, t as (select project_id, seq, concat('• ', name, '@', version, ' (', license, ')',
 chr(10), array_to_string(list_transform(issues, lambda x: concat('  - ', x, chr(10))), '')) as item
 from p where not compatible)
 select project_id, cast(floor(seq / 100) as bigint) as page,
 concat('**Incompatible Packages:**', chr(10), string_agg(item, '' order by seq, item)) as text from t group by all""",
}
