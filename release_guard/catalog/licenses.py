"""Licence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..fixtures import frame, with_views
from ..functions.licenses import normalize_license, squash_license
from ..functions.scoring import license_risk_level
from ..operators import licenses as lic
from ..plans.audits import license_compliance

ALLOWED = ["MIT", "ISC", "Apache-2.0", "GPLv3", "BSD"]
BLOCKED = ["GPL-3.0", "GPL-2.0"]
PROJECT = "MIT"
TARGET = "pkg-7"


def manifest(sp, sf):
    return frame(sp, sf, "fx_manifest")


def installed(sp, sf):
    return frame(sp, sf, "fx_installed")


def packages(sp, sf):
    return license_compliance(manifest(sp, sf), installed(sp, sf), ALLOWED, BLOCKED, PROJECT, True)["packages"]


def audited(sp, sf, mode="reference"):
    return lic.audit_licenses(merged(sp, sf), installed(sp, sf), mode=mode)


def merged(sp, sf):
    return lic.merge_scopes(manifest(sp, sf))


def _merged_tables(sp, sf):
    both = manifest(sp, sf)
    dev = both.filter(F.col("dep_scope") == "dev")
    return lic.merge_deps(lic.production_only(both).drop("dep_scope"), dev.drop("dep_scope"))


def _text(df):
    return df.withColumn("issues", F.array_join("issues", "; "))


def _allow_free(sp, sf):
    """The check without lists and with a project licence that differs by project."""
    chosen = F.when(F.col("project_id") % 4 == 0, "GPL-3.0").when(F.col("project_id") % 4 == 1, "UNKNOWN").when(
        F.col("project_id") % 4 == 2, "CC0-1.0").otherwise("Apache 2.0")
    return lic.analyze_license(
        lic.resolve_licenses(manifest(sp, sf), installed(sp, sf)), project_license=chosen
    )


QUERIES = {
    "production_only": lambda sp, sf: lic.production_only(manifest(sp, sf)),
    "merge_deps": _merged_tables,
    "resolve_licenses": lambda sp, sf: lic.resolve_licenses(manifest(sp, sf), installed(sp, sf)),
    "normalize_license": lambda sp, sf: installed(sp, sf).select(
        "seq", normalize_license(F.col("license")).alias("spdx"), squash_license(F.col("license")).alias("squashed")
    ),
    "analyze_license": lambda sp, sf: _text(packages(sp, sf)),
    "analyze_license_by_project": lambda sp, sf: _text(_allow_free(sp, sf)),
    "license_summary": lambda sp, sf: lic.license_summary(packages(sp, sf)),
    "incompatible_packages": lambda sp, sf: lic.incompatible_packages(packages(sp, sf)).drop("issues"),
    "unknown_license_packages": lambda sp, sf: lic.unknown_license_packages(packages(sp, sf)).drop("issues"),
    "check_package_license": lambda sp, sf: _text(lic.check_package_license(packages(sp, sf), TARGET)),
    "license_recommendations": lambda sp, sf: lic.license_recommendations(packages(sp, sf), width=50),
    "license_compliance": lambda sp, sf: license_compliance(
        manifest(sp, sf), installed(sp, sf), project_license="GPL-3.0"
    )["summary"],
    "audit_licenses": lambda sp, sf: _text(audited(sp, sf)),
    "audit_licenses_normalized": lambda sp, sf: _text(audited(sp, sf, "normalized")),
    "license_audit_summary": lambda sp, sf: lic.license_audit_summary(audited(sp, sf, "normalized")),
    "license_audit_recommendations": lambda sp, sf: lic.license_audit_recommendations(audited(sp, sf, "normalized")),
    "license_risk_level": lambda sp, sf: lic.license_audit_summary(audited(sp, sf)).select(
        "project_id", license_risk_level(F.col("incompatible"), F.col("unknown")).alias("risk")
    ),
}


def _list(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def spdx_sql(name: str) -> str:
    aliases = " ".join(f"when '{a}' then '{b}'" for a, b in rules.LICENSE_ALIASES.items())
    return f"case when {name} in ('', 'UNKNOWN', 'undefined') then null else case {name} {aliases} else {name} end end"


def fits_sql(project: str, dependency: str) -> str:
    """Compatibility of two SPDX ids; null counts as false."""
    arms = " ".join(
        f"when '{k}' then {dependency} in ({_list(v)})" for k, v in rules.LICENSE_COMPATIBILITY.items()
    )
    return f"coalesce(case {project} {arms} else {project} = {dependency} end, false)"


MERGED = """merged as (select project_id, name, arg_max(version_range, (dep_scope = 'dev', version_range)) as version_range,
 min(seq) as seq from fx_manifest group by project_id, name)"""


def packages_sql(deps: str, project: str, allowed=(), blocked=()) -> str:
    """CTE ``p``: resolved and analysed packages of a dependency table."""
    blocked_sql = f"license in ({_list(blocked)})" if blocked else "false"
    allowed_sql = f"license not in ({_list(allowed)})" if allowed else "false"
    return f"""q as (select m.project_id, m.seq, m.name, m.version_range as version,
 coalesce(nullif(i.license, ''), 'UNKNOWN') as license from {deps} m join fx_installed i on i.name = m.name),
 q2 as (select *, {project} as pl, {spdx_sql('license')} as spdx from q),
 p as (select project_id, seq, name, version, license, coalesce(spdx, '') as spdx_id, issues, len(issues) = 0 as compatible
 from (select *, list_filter([
 case when {blocked_sql} then 'License "' || license || '" is explicitly blocked' end,
 case when {allowed_sql} then 'License "' || license || '" is not in the allowed list' end,
 case when pl <> '' and license <> 'UNKNOWN' and not {fits_sql(spdx_sql('pl'), 'spdx')}
 then 'License "' || license || '" is incompatible with project license "' || pl || '"' end,
 case when license in ('UNKNOWN', 'undefined') then 'License information is missing or unknown' end],
 lambda x: x is not null) as issues from q2))"""


BASE = with_views("fx_manifest", "fx_installed")
PROD = "prod as (select project_id, seq, name, version_range from fx_manifest where dep_scope = 'prod')"
PACKAGES = f"{BASE}, {MERGED}, {packages_sql('merged', repr(PROJECT), ALLOWED, BLOCKED)}"
SUMMARY = """s as (select project_id, count(*) as total, count(*) filter (compatible) as compatible,
 count(*) filter (not compatible) as incompatible, count(*) filter (license in ('UNKNOWN', 'undefined')) as unknown,
 cast(sum(len(issues)) as bigint) as issues from p group by project_id)"""
TEXT = "* replace (array_to_string(issues, '; ') as issues)"
BY_PROJECT = "case project_id % 4 when 0 then 'GPL-3.0' when 1 then 'UNKNOWN' when 2 then 'CC0-1.0' else 'Apache 2.0' end"


def audit_sql(normalized: bool) -> str:
    def any_of(entries) -> str:
        needles = [e.lower().replace("-", "").replace(".", "") if normalized else e.lower() for e in entries]
        return "(" + " or ".join(f"contains(sq, '{n}')" for n in needles) + ")"

    blocked = any_of(rules.AUDIT_RESTRICTED_LICENSES)
    allowed = any_of(rules.AUDIT_ALLOWED_LICENSES)
    return f"""{BASE}, {MERGED}, q as (select m.project_id, m.seq, m.name, m.version_range as version,
 coalesce(nullif(i.license, ''), 'unknown') as license, i.name is not null as found
 from merged m left join fx_installed i on i.name = m.name),
 q2 as (select *, regexp_replace(lower(license), '[^a-z0-9]', '', 'g') as sq from q),
 p as (select project_id, seq, name, version, license, found, found and not {blocked} as compatible,
 case when found then list_filter([
 case when {blocked} then concat('License ', license, ' is in the restricted list') end,
 case when not {allowed} then concat('License ', license, ' is not in the allowed list') end],
 lambda x: x is not null) else ['License information not available'] end as issues from q2)"""


AUDIT_TOTALS = """t as (select project_id, count(*) as total, count(*) filter (found and compatible) as compatible,
 count(*) filter (found and not compatible) as incompatible, count(*) filter (not found) as unknown
 from p group by project_id)"""


def risk_sql(bad: str, unknown: str) -> str:
    return f"""case when {bad} > 5 then 'critical' when {bad} > 2 or {unknown} > 10 then 'high'
 when {bad} > 0 or {unknown} > 5 then 'medium' else 'low' end"""


_L, _A = rules.LICENSE_SENTENCES, rules.LICENSE_AUDIT_SENTENCES


def _say(text: str, count: str) -> str:
    before, after = text.split("{}")
    return f"concat('{before}', {count}, '{after}')"


def recommendations_sql(width: int) -> str:
    """CTE ``r``: the sentences of the compliance check."""
    return f"""n as (
 select project_id, 3 as rec_no, seq, name from p
 where not compatible and len(list_filter(issues, lambda x: contains(x, 'blocked'))) > 0
 union all select project_id, 4, seq, name from p where not compatible and license in ('UNKNOWN', 'undefined')),
 r as (select project_id, 1 as rec_no, cast(0 as bigint) as page, concat('🚨 ', incompatible, '{_L["incompatible"]}') as text
 from s where incompatible > 0
 union all select project_id, 2, 0, concat('⚠️ ', unknown, '{_L["unknown"]}') from s where unknown > 0
 union all select project_id, rec_no, cast(floor(seq / {width}) as bigint),
 concat(case rec_no when 3 then '{_L["blocked"]}' else '{_L["investigate"]}' end, string_agg(name, ', ' order by seq, name))
 from n group by project_id, rec_no, floor(seq / {width})
 union all select project_id, 5, 0, '{_L["clean"]}' from s where compatible = total)"""


AUDIT_RECOMMENDATIONS = f"""ra as (select project_id,
 count(*) filter (not compatible) as bad, count(*) filter (license = 'unknown') as unk from p group by project_id),
 r as (select project_id, 1 as rec_no, {_say(_A["incompatible"], "bad")} as text from ra where bad > 0
 union all select project_id, 2, '{_A["review"]}' from ra where bad > 0
 union all select project_id, 3, {_say(_A["unknown"], "unk")} from ra where unk > 0
 union all select project_id, 4, '{_A["verify"]}' from ra where unk > 0
 union all select project_id, 5, '{_A["clean"]}' from ra where bad = 0 and unk = 0)"""

ORACLES = {
    "production_only": f"{with_views('fx_manifest')} select * from fx_manifest where dep_scope = 'prod'",
    "merge_deps": f"{with_views('fx_manifest')}, {MERGED} select * from merged",
    "resolve_licenses": f"""{BASE}, {PROD} select m.project_id, m.seq, m.name, m.version_range as version,
 coalesce(nullif(i.license, ''), 'UNKNOWN') as license from prod m join fx_installed i on i.name = m.name""",
    "normalize_license": f"""{with_views('fx_installed')} select seq, {spdx_sql('license')} as spdx,
 regexp_replace(lower(license), '[^a-z0-9]', '', 'g') as squashed from fx_installed""",
    "analyze_license": f"{PACKAGES} select {TEXT} from p",
    "analyze_license_by_project": f"{BASE}, {PROD}, {packages_sql('prod', BY_PROJECT)} select {TEXT} from p",
    "license_summary": f"{PACKAGES}, {SUMMARY} select * from s",
    "incompatible_packages": f"{PACKAGES} select * exclude (issues) from p where not compatible",
    "unknown_license_packages": f"{PACKAGES} select * exclude (issues) from p where license in ('UNKNOWN', 'undefined')",
    "check_package_license": f"""{PACKAGES} select {TEXT} from (select * from p where name = '{TARGET}'
 qualify row_number() over (partition by project_id order by seq, version) = 1)""",
    "license_recommendations": f"{PACKAGES}, {SUMMARY}, {recommendations_sql(50)} select * from r",
    "license_compliance": f"""{BASE}, {PROD}, {packages_sql('prod', "'GPL-3.0'")}, {SUMMARY} select * from s""",
    "audit_licenses": f"{audit_sql(False)} select {TEXT} from p",
    "audit_licenses_normalized": f"{audit_sql(True)} select {TEXT} from p",
    "license_audit_summary": f"""{audit_sql(True)}, {AUDIT_TOTALS}
 select *, {risk_sql('incompatible', 'unknown')} as risk_level from t""",
    "license_audit_recommendations": f"{audit_sql(True)}, {AUDIT_RECOMMENDATIONS} select * from r",
    "license_risk_level": f"""{audit_sql(False)}, {AUDIT_TOTALS}
 select project_id, {risk_sql('incompatible', 'unknown')} as risk from t""",
}
