"""Secret scanning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..fixtures import frame, with_views
from ..functions.text import shannon_entropy
from ..operators import secrets as s
from ..plans.scan import project_scan, scan_folder, secret_scan
from ..rules import SecretPattern
from ..session import scratch_dir

INCLUDE = ["**/*.ts", "**/*.js"]
EXCLUDE = ["src1/**"]
CUSTOM = [
    SecretPattern("Private Address", r"\b(?:10|192)\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "low", "Address", 1.0),
    SecretPattern("E-mail", r"[A-Za-z0-9._]+@[A-Za-z0-9-]+\.[a-z]{2,}", "low", "Mail address", 2.0),
]
SCAN_TIME = "2024-01-20 00:00:00"


def _files(spark, sf):
    return frame(spark, sf, "fx_files")


def _planted(spark, sf):
    return frame(spark, sf, "fx_planted")


def _inputs(spark, sf):
    """Documents and conversations together, the input of the whole scan."""
    columns = ["project_id", "file", "content"]
    return _files(spark, sf).select(columns).unionByName(_planted(spark, sf).select(columns))


def scan_inputs(spark, sf):
    return secret_scan(_inputs(spark, sf))


def _allowed(spark, sf):
    """Secrets the projects allow: those found in every fifth project's files."""
    return scan_planted(spark, sf).filter(F.col("project_id") % 5 == 0).select("value").distinct()


def scan_planted(spark, sf):
    return secret_scan(_planted(spark, sf))


def scan_before(spark, sf):
    return secret_scan(frame(spark, sf, "fx_planted_before"))


def diff(spark, sf):
    return s.secret_diff(scan_planted(spark, sf), scan_before(spark, sf))


def pattern_entropy(spark, sf):
    return _planted(spark, sf).select("file", F.round(shannon_entropy(F.col("content")), 6).alias("entropy"))


def project_folder(spark, sf, label: str) -> str:
    """A folder with one text file per project, holding all its inputs by name, one after the other."""
    path = scratch_dir(spark, label)
    ordered = _inputs(spark, sf).repartition("project_id").sortWithinPartitions("project_id", "file")
    ordered.select("project_id", F.coalesce("content", F.lit("")).alias("value")).write.partitionBy("project_id").text(path)
    return path


def by_project(findings):
    """Findings of ``project_folder``, without the names Spark gave the files."""
    project = F.regexp_extract("file", "project_id=([0-9]+)/", 1).cast("long")
    return findings.select(project.alias("project_id"), *[c for c in findings.columns if c not in ("file", "size")])


QUERIES = {
    "scan_folder": lambda sp, sf: by_project(scan_folder(sp, project_folder(sp, sf, "checkout"), include=["**/*.txt"])),
    "project_scan": lambda sp, sf: project_scan(
        _inputs(sp, sf), frame(sp, sf, "fx_project_patterns"), allowed=_allowed(sp, sf)
    ),
    "split_lines": lambda sp, sf: s.split_lines(_files(sp, sf).select("file", "content")),
    "match_patterns": lambda sp, sf: s.match_patterns(s.split_lines(_planted(sp, sf))),
    "high_entropy_tokens": lambda sp, sf: s.high_entropy_tokens(
        s.split_lines(_inputs(sp, sf))
    ).drop("pattern_entropy"),
    "entropy_filter": lambda sp, sf: s.entropy_filter(
        s.match_patterns(s.split_lines(_planted(sp, sf))).withColumn("pattern_entropy", F.lit(None).cast("double")),
        3.9,
    ).drop("pattern_entropy"),
    "shannon_entropy": pattern_entropy,
    "secret_scan": lambda sp, sf: secret_scan(_inputs(sp, sf), allowed=_allowed(sp, sf), whole_lines=True),
    "scan_documents": lambda sp, sf: secret_scan(_files(sp, sf).select("file", "content"), whole_lines=True),
    "apply_allowlist": lambda sp, sf: s.apply_allowlist(scan_planted(sp, sf), _allowed(sp, sf)),
    "clean_files": lambda sp, sf: s.clean_files(
        _inputs(sp, sf), scan_inputs(sp, sf)
    ),
    "severity_rollup": lambda sp, sf: s.severity_rollup(scan_inputs(sp, sf)),
    "severity_members": lambda sp, sf: s.severity_members(scan_inputs(sp, sf)).select(
        "severity", "file", "line", "column", "pattern_name"
    ),
    "user_patterns": lambda sp, sf: s.match_patterns(
        s.split_lines(_files(sp, sf).select("file", "content")), CUSTOM, whole_lines=True
    ),
    "all_patterns": lambda sp, sf: s.match_patterns(
        s.split_lines(_inputs(sp, sf)), s.all_patterns(rules.DEFAULT_PATTERNS, CUSTOM)
    ).groupBy("pattern_name").agg(F.count("*").alias("findings"), F.count_distinct("value").alias("distinct_values")),
    "secret_diff": lambda sp, sf: diff(sp, sf).drop("project_id"),
    "secret_diff_summary": lambda sp, sf: s.secret_diff_summary(diff(sp, sf)),
    "added_findings": lambda sp, sf: s.added_findings(scan_planted(sp, sf), scan_before(sp, sf)),
    "removed_findings": lambda sp, sf: s.removed_findings(scan_planted(sp, sf), scan_before(sp, sf)),
    "baseline_as_of": lambda sp, sf: s.baseline_as_of(
        frame(sp, sf, "fx_scans"), since=F.lit(SCAN_TIME).cast("timestamp_ntz")
    ),
    "baseline_of_version": lambda sp, sf: s.baseline_as_of(frame(sp, sf, "fx_scans"), version="1.7.0"),
    "baselines_as_of": lambda sp, sf: s.baselines_as_of(frame(sp, sf, "fx_scans"), frame(sp, sf, "fx_cutoffs")),
    "finding_lifetimes": lambda sp, sf: s.finding_lifetimes(
        frame(sp, sf, "fx_scan_runs"), frame(sp, sf, "fx_scan_findings")
    ),
    "added_copies": lambda sp, sf: s.added_copies(
        frame(sp, sf, "fx_scan_findings").where("scan_id = 2"), frame(sp, sf, "fx_scan_findings").where("scan_id = 1"),
        ["project_id", "file", "pattern_name", "value"],
    ),
    "scan_coverage": lambda sp, sf: s.scan_coverage(_files(sp, sf), INCLUDE, EXCLUDE, ["project_id"]),
    "false_positive_rate": lambda sp, sf: s.false_positive_rate(scan_planted(sp, sf), _allowed(sp, sf)),
    "secret_audit_history": lambda sp, sf: s.secret_audit_history(
        frame(sp, sf, "fx_scans").withColumn("scan_ts", F.date_trunc("hour", "scan_ts").cast("timestamp_ntz"))
    ),
}


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lines_sql(source: str, name: str) -> str:
    """All lines of a file table as a CTE."""
    return f"""{name} as (select * exclude (content, parts), unnest(parts) as text,
 cast(generate_subscripts(parts, 1) as int) as line
 from (select *, regexp_split_to_array(content, '\\r?\\n') as parts from {source}))"""


def hits_sql(lines: str, regex: str, label: str, severity: str, entropy: float | None) -> str:
    """Matches of one regex with their columns."""
    entropy_text = "cast(null as double)" if entropy is None else f"cast({entropy} as double)"
    return f"""select * exclude (vals, gaps, cols), unnest(vals) as value, cast(unnest(cols) as int) as "column",
 {_quote(label)} as pattern_name, {_quote(severity)} as severity, {entropy_text} as pattern_entropy from (
 select *, list_transform(range(1, len(vals) + 1), lambda i: 1
 + list_sum(list_transform(gaps[1:i], lambda g: length(g)))
 + coalesce(list_sum(list_transform(vals[1:i - 1], lambda v: length(v))), 0)) as cols from (
 select *, regexp_extract_all(text, {_quote(regex)}) as vals, regexp_split_to_array(text, {_quote(regex)}) as gaps
 from {lines} where regexp_matches(text, {_quote(regex)})))"""


def named_sql(lines: str, patterns=tuple(rules.DEFAULT_PATTERNS)) -> str:
    return " union all ".join(hits_sql(lines, p.regex, p.name, p.severity, p.entropy) for p in patterns)


ENTROPY = "round(list_entropy(string_split(value, '')), 6)"
CONTEXT = f"""substr(text, greatest("column" - {rules.CONTEXT_BEFORE}, 1),
 least("column" - 1, {rules.CONTEXT_BEFORE}) + {rules.CONTEXT_AFTER}) as context"""
WHOLE_LINE = "text as context"


def scan_sql(source: str, name: str, context: str = CONTEXT) -> str:
    """CTEs that end in ``name``: the findings of a whole scan over a file table."""
    return f"{lines_sql(source, name + '_lines')},\n{found_sql(name, named_sql(name + '_lines'), context=context)}"


def found_sql(name: str, named: str, key: str = "file", context: str = CONTEXT) -> str:
    """CTEs that end in ``name``: the findings in ``<name>_lines`` of the hits ``named`` and of tokens."""
    token = hits_sql(f"{name}_lines", rules.TOKEN_REGEX, rules.TOKEN_PATTERN_NAME, rules.TOKEN_SEVERITY, None)
    return f"""{name}_named as ({named}),
{name}_tokens as (select t.* from ({token}) t where not exists (
 select 1 from {name}_named n where n.{key} = t.{key} and n.line = t.line
 and n."column" < t."column" + length(t.value) and t."column" < n."column" + length(n.value))),
{name} as (select * exclude (pattern_entropy, text), {context} from (
 select *, {ENTROPY} as entropy from (select * from {name}_named union all by name select * from {name}_tokens))
 where entropy >= coalesce(pattern_entropy, {rules.ENTROPY_THRESHOLD}))"""


INPUTS = """inputs as (select project_id, file, content from fx_files
 union all select project_id, file, content from fx_planted)"""
ALL = f"{with_views('fx_files', 'fx_planted')}, {INPUTS}"
PLANTED = f"{with_views('fx_planted')}, {scan_sql('fx_planted', 'found')}"
ALLOWED = "allowed as (select distinct value from found where project_id % 5 = 0)"
BOTH = (
    f"{with_views('fx_planted', 'fx_planted_before')}, {scan_sql('fx_planted', 'cur')},"
    f" {scan_sql('fx_planted_before', 'old')}"
)
DIFF = f"""{BOTH}, diff as (select file, line, "column", pattern_name,
 coalesce(cur.severity, old.severity) as severity, cur.value as value, old.value as old_value,
 case when old.value is null then 'added' when cur.value is null then 'removed'
 when cur.value <> old.value then 'modified' else 'unchanged' end as change
 from cur full join old using (file, line, "column", pattern_name))"""
FOUND_ALL = f"{ALL}, {scan_sql('inputs', 'found')}"
# All inputs of a project as one file, one after the other.
FOLDERS = """folders as (select project_id, string_agg(coalesce(content, ''), chr(10) order by file) as content
 from inputs group by project_id)"""
# Hits of the patterns of each line's own project, whose regex is a column.
OWN_HITS = """select * exclude (vals, gaps, cols, regex, seq), unnest(vals) as value, cast(unnest(cols) as int) as "column" from (
 select *, list_transform(range(1, len(vals) + 1), lambda i: 1 + list_sum(list_transform(gaps[1:i], lambda g: length(g)))
 + coalesce(list_sum(list_transform(vals[1:i - 1], lambda v: length(v))), 0)) as cols from (
 select l.*, p.regex, p.seq, p.name as pattern_name, p.severity, p.entropy as pattern_entropy,
 regexp_extract_all(text, p.regex) as vals, regexp_split_to_array(text, p.regex) as gaps
 from mixed_lines l join fx_project_patterns p on p.project_id = l.project_id
 where p.regex is not null and regexp_matches(text, p.regex)))"""
SCANNED = r"regexp_matches(file, '\.(ts|js)$') and not starts_with(file, 'src1/')"

ORACLES = {
    "scan_folder": f"""{ALL}, {FOLDERS}, {lines_sql('folders', 'found_lines')},
 {found_sql('found', named_sql('found_lines'), 'project_id')} select * replace (cast(line as bigint) as line) from found""",
    "project_scan": f"""{with_views('fx_files', 'fx_planted', 'fx_project_patterns')}, {INPUTS},
 {lines_sql('inputs', 'mixed_lines')}, {found_sql('mixed', named_sql('mixed_lines') + ' union all by name ' + OWN_HITS)},
 {scan_sql('fx_planted', 'found')}, {ALLOWED}
 select * from mixed where value not in (select value from allowed)""",
    "split_lines": f"""{with_views('fx_files')}, {lines_sql('(select file, content from fx_files)', 'l')}
 select * from l""",
    "match_patterns": f"""{with_views('fx_planted')}, {lines_sql('fx_planted', 'l')}, h as ({named_sql('l')})
 select * exclude (text), {CONTEXT}, {ENTROPY} as entropy from h""",
    "high_entropy_tokens": f"""{ALL}, {scan_sql('inputs', 'found')}
 select * from found where pattern_name = {_quote(rules.TOKEN_PATTERN_NAME)}""",
    "entropy_filter": f"""{with_views('fx_planted')}, {lines_sql('fx_planted', 'l')}, h as ({named_sql('l')})
 select * from (select * exclude (text, pattern_entropy), {CONTEXT}, {ENTROPY} as entropy from h)
 where entropy >= 3.9""",
    "shannon_entropy": f"""{with_views('fx_planted')}
 select file, round(list_entropy(string_split(content, '')), 6) as entropy from fx_planted""",
    "secret_scan": f"""{ALL}, {scan_sql('inputs', 'all_found', WHOLE_LINE)}, {scan_sql('fx_planted', 'found')}, {ALLOWED}
 select * from all_found where value not in (select value from allowed)""",
    "scan_documents": f"""{with_views('fx_files')}, {scan_sql('(select file, content from fx_files)', 'found', WHOLE_LINE)}
 select * from found""",
    "apply_allowlist": f"{PLANTED}, {ALLOWED} select * from found where value not in (select value from allowed)",
    "clean_files": f"""{FOUND_ALL} select project_id, file from inputs
 where file not in (select file from found)""",
    "severity_rollup": f"""{FOUND_ALL} select severity, count(*) as findings, count(distinct file) as files
 from found group by severity""",
    "severity_members": f"""{FOUND_ALL} select severity, file, line, "column", pattern_name from found""",
    "user_patterns": f"""{with_views('fx_files')}, {lines_sql('(select file, content from fx_files)', 'l')},
 h as ({named_sql('l', CUSTOM)}) select * exclude (text), {WHOLE_LINE}, {ENTROPY} as entropy from h""",
    "all_patterns": f"""{ALL}, {lines_sql('inputs', 'l')},
 h as ({named_sql('l', [*rules.DEFAULT_PATTERNS, *CUSTOM])})
 select pattern_name, count(*) as findings, count(distinct value) as distinct_values from h group by pattern_name""",
    "secret_diff": f"{DIFF} select * from diff",
    "secret_diff_summary": f"""{DIFF} select *, case
 when (select count(*) from diff where change = 'added' and severity = 'critical') > 0 then 'critical'
 when (select count(*) from diff where change = 'added' and severity = 'high') > 0 then 'high'
 when total_added + total_modified > 0 then 'medium' else 'low' end as risk_level from (
 select count(*) filter (change = 'added') as total_added, count(*) filter (change = 'removed') as total_removed,
 count(*) filter (change = 'modified') as total_modified,
 count(*) filter (change = 'unchanged') as total_unchanged from diff)""",
    "added_findings": f"""{BOTH} select * from cur
 where (file, line, "column", pattern_name) not in (select (file, line, "column", pattern_name) from old)""",
    "removed_findings": f"""{BOTH} select * from old
 where (file, line, "column", pattern_name) not in (select (file, line, "column", pattern_name) from cur)""",
    "baseline_as_of": f"""{with_views('fx_scans')} select project_id, scan_id, scan_ts, version from fx_scans
 where scan_ts <= timestamp '{SCAN_TIME}'
 qualify row_number() over (partition by project_id order by scan_ts desc, scan_id desc) = 1""",
    "baseline_of_version": f"""{with_views('fx_scans')} select project_id, scan_id, scan_ts, version from fx_scans
 where version = '1.7.0'
 qualify row_number() over (partition by project_id order by scan_ts desc, scan_id desc) = 1""",
    "baselines_as_of": f"""{with_views('fx_scans', 'fx_cutoffs')}, newest as (select project_id, scan_ts,
 max(scan_id) as scan_id, arg_max(version, scan_id) as version from fx_scans group by project_id, scan_ts)
 select c.project_id, c.cut_id, c.since, n.scan_id, n.scan_ts, n.version from fx_cutoffs c asof left join newest n
 on c.project_id = n.project_id and c.since >= n.scan_ts""",
    "finding_lifetimes": f"""{with_views('fx_scan_runs', 'fx_scan_findings')},
 numbered as (select *, row_number() over (partition by project_id order by scan_ts, scan_id) as n from fx_scan_runs),
 held as (select distinct project_id, file, pattern_name, value, n, scan_ts
 from fx_scan_findings join numbered using (project_id, scan_id)),
 runs as (select *, n - row_number() over (partition by project_id, file, pattern_name, value order by n) as run from held),
 lives as (select project_id, file, pattern_name, value, run, min(scan_ts) as introduced_at, max(scan_ts) as last_seen_at,
 count(*) as scans, max(n) + 1 as n from runs group by all),
 placed as (select *, row_number() over (partition by project_id, file, pattern_name, value order by run) as occurrence from lives)
 select project_id, file, pattern_name, value, cast(occurrence as int) as occurrence,
 case when occurrence = 1 then 'introduced' else 'reintroduced' end as event, introduced_at, last_seen_at,
 numbered.scan_ts as fixed_at, scans from placed left join numbered using (project_id, n)""",
    "added_copies": f"""{with_views('fx_scan_findings')}
 select project_id, file, pattern_name, value from fx_scan_findings where scan_id = 2
 except all select project_id, file, pattern_name, value from fx_scan_findings where scan_id = 1""",
    "scan_coverage": f"""{with_views('fx_files')} select project_id, count(*) as files,
 count(*) filter ({SCANNED}) as scanned, avg(case when {SCANNED} then 1 else 0 end) as coverage
 from fx_files group by project_id""",
    "false_positive_rate": f"""{PLANTED}, {ALLOWED} select pattern_name, count(*) as findings,
 avg(case when value in (select value from allowed) then 1 else 0 end) as false_positive_rate
 from found group by pattern_name""",
    "secret_audit_history": f"""{with_views('fx_scans')} select date_trunc('hour', scan_ts) as scan_ts, severity,
 count(*) as findings from fx_scans group by all""",
}
