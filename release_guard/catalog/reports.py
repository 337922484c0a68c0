"""Report queries."""

from __future__ import annotations

from .. import rules
from ..fixtures import frame, with_views
from ..plans import reports as r
from ..session import stored
from ..sources.manifests import parse_audit_json
from . import licenses as lic
from . import sources as src
from . import versions as ver
from . import vulnerabilities as vul

REPORT_TIME = "2024-01-31T00:00:00Z"

QUERIES = {
    "report_rows": lambda sp, sf: r.vulnerability_report(vul.vulns(sp, sf), REPORT_TIME),
    "audit_report": lambda sp, sf: r.vulnerability_report(
        stored(parse_audit_json(frame(sp, sf, "fx_audit_json").select("project_id", "audit_json"), vul.AUDIT_TIME), "audited"),
        REPORT_TIME,
    ),
    "license_report": lambda sp, sf: r.license_report(
        stored(lic.packages(sp, sf), "packages"), lic.PROJECT, REPORT_TIME
    ),
    "license_audit_report": lambda sp, sf: r.license_audit_report(
        stored(lic.audited(sp, sf, "normalized"), "licenses")
    ),
    "changelog_report": lambda sp, sf: r.changelog_report(frame(sp, sf, "fx_commits")),
    "analytics_report": lambda sp, sf: r.analytics_report(frame(sp, sf, "fx_events")),
}


def _block(source: str, key: str, no: int, section: str, item: str, lines: list[str], part: str | None = None) -> str:
    """All non-null lines of every source row."""
    order = "" if part is None else f" cast({part} as bigint) as part,"
    return " union all ".join(
        f"select {key}, {no} as section_no, '{section}' as section, cast({item} as bigint) as item,{order}"
        f" {i} as line_no, {text} as text from {source} where {text} is not null"
        for i, text in enumerate(lines)
    )


def _bullets(pairs) -> list[str]:
    return [f"concat('- **{label}:** ', {name})" for label, name in pairs]


def _vuln_report(*more: str, title: str, description: str) -> str:
    return " union all ".join([
        _block("s", "project_id", 0, "Dependency Security Audit Report", "0", [f"'**Generated:** {REPORT_TIME}'"], "0"),
        _block("s", "project_id", 1, "Summary", "0", _bullets([
            ("Total Vulnerabilities", "total"), ("Critical", "critical"), ("High", "high"), ("Moderate", "moderate"),
            ("Low", "low")]), "0"),
        _block("sc", "project_id", 2, "Security Score", "0", ["concat('**', score, '/100** ', band)"], "0"),
        _block("r", "project_id", 3, "Recommendations", "rec_no * 1000000 + page", ["concat('- ', text)"], "0"),
        _block("g", "project_id", 4, "Vulnerabilities by Package", "first_seq", ["concat('### ', package, '@', version)"], "0"),
        _block("(select v.*, g.first_seq from v join g on g.project_id = v.project_id and g.package = v.package)",
               "project_id", 4, "Vulnerabilities by Package", "first_seq", [
                   f"concat('- **', upper(severity), ':** ', {title})", f"concat('  - ', {description})",
                   "'  - **Fixed in:** ' || nullif(fixed_in, '')", *more], "seq + 1"),
    ])


LICENSE_REPORT = " union all ".join([
    _block("s", "project_id", 0, "License Compliance Report", "0", [
        f"'**Generated:** {REPORT_TIME}'", f"'**Project License:** {lic.PROJECT}'"]),
    _block("s", "project_id", 1, "Summary", "0", _bullets([
        ("Total Packages", "total"), ("Compatible", "compatible"), ("Incompatible", "incompatible"),
        ("Unknown", "unknown"), ("Total Issues", "issues")])),
    _block("r", "project_id", 2, "Recommendations", "rec_no * 1000000 + page", ["concat('- ', text)"]),
    _block("(select * from p where not compatible)", "project_id", 3, "Incompatible Packages", "seq", [
        "concat('### ', name, '@', version)", "concat('- **License:** ', license)",
        "concat('- **SPDX ID:** ', coalesce(nullif(spdx_id, ''), 'Unknown'))", "'- **Issues:**'",
        *[f"'  - ' || issues[{i}]" for i in range(1, 5)]]),
])
AUDIT_REPORT = " union all ".join([
    _block("t2", "project_id", 1, "Summary", "0", [
        f"concat('  • {label}: ', {name})" for label, name in [
            ("Total packages", "total"), ("Compatible", "compatible"), ("Incompatible", "incompatible"),
            ("Unknown", "unknown"), ("Risk Level", "upper(risk_level)")]]),
    _block("(select * from p where not compatible and project_id in (select project_id from t where incompatible > 0))",
           "project_id", 2, "Incompatible Licenses", "seq", [
               "concat('  • ', name, '@', version, ' - ', license)",
               *[f"'    - ' || issues[{i}]" for i in (1, 2)]]),
    _block("(select * from p where license = 'unknown' and project_id in (select project_id from t where unknown > 0))",
           "project_id", 3, "Unknown Licenses", "seq", ["concat('  • ', name, '@', version)"]),
    _block("r", "project_id", 4, "Recommendations", "rec_no", ["concat('  • ', text)"]),
])
AUDITED = f"with v as ({src.ORACLES['parse_audit_json']})"
ENTRIES = f"{ver.COMMITS}, e as (select repo, seq, {ver.SECTION} as section, {ver.ENTRY} as entry from parsed)"
CHANGELOG = " union all ".join(
    _block(f"(select * from e where section = '{name}')", "repo", no, rules.CHANGELOG_TITLES[name], "seq",
           ["concat('- ', entry)"])
    for no, name in enumerate(rules.CHANGELOG_SECTIONS, start=1)
)

ORACLES = {
    "report_rows": f"""{vul.VULNS}, {vul.SUMMARY}, {vul.PACKAGES}, {vul.recommendations_sql(None)}, g as ({vul.GROUPED}),
 sc as (select *, {vul.BAND} as band from (select *, {vul.SCORE} as score from s))
 {_vuln_report(title="concat('Vulnerability in ', package)", description=f"'{rules.NO_DESCRIPTION}'")}""",
    "audit_report": f"""{AUDITED}, {vul.SUMMARY}, {vul.PACKAGES}, {vul.recommendations_sql(None)}, g as ({vul.GROUPED}),
 sc as (select *, {vul.BAND} as band from (select *, {vul.SCORE} as score from s))
 {_vuln_report("'  - **CVSS:** ' || cvss_score || ' (' || cvss_vector || ')'", title="title", description="description")}""",
    "license_report": f"{lic.PACKAGES}, {lic.SUMMARY}, {lic.recommendations_sql(1000)} {LICENSE_REPORT}",
    "license_audit_report": f"""{lic.audit_sql(True)}, {lic.AUDIT_TOTALS}, {lic.AUDIT_RECOMMENDATIONS},
 t2 as (select *, {lic.risk_sql('incompatible', 'unknown')} as risk_level from t) {AUDIT_REPORT}""",
    "changelog_report": f"{ENTRIES} {CHANGELOG}",
    "analytics_report": f"""{with_views('fx_events')}, t as (select type, count(*) as n, min(seq) as first_seq
 from fx_events group by type) select '📊 {rules.TOOL_NAME} Analytics Report' as report, 1 as section_no,
 first_seq as item, concat(case type when 'publish' then '📦' when 'scan' then '🔐' when 'unpublish' then '⛔'
 else 'ℹ️' end, ' ', type, ': ', n) as text from t
 union all select '📊 {rules.TOOL_NAME} Analytics Report', 2, null, concat('Total events: ', sum(n)) from t""",
}
