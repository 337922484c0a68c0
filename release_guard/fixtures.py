"""Test inputs derived from the driver tables.

Each view is a list of SQL expressions over one table. The text is valid in
Spark SQL and in ANSI SQL, so the jobs and their checks read the same input.
Every view keeps all rows of its table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .session import configure


@dataclass(frozen=True)
class View:
    base: str
    columns: dict[str, str]
    where: str | None = None
    distinct: bool = False
    # Rows that are costly to work on are dealt out first: a table in few row groups is read by as few tasks.
    spread: bool = False


def _text(expr: str) -> str:
    return f"cast({expr} as varchar(20))"


_ORDER_TEXT = _text("o_orderkey")
_PLANTED_TAIL = """case conv_id % 6
 when 0 then concat('key=AKIA', upper(substr(md5(text), 1, 16)))
 when 1 then concat('push with ghp_', substr(concat(md5(text), md5(role)), 1, 36))
 when 2 then concat('charge sk_live_', substr(md5(text), 1, 24))
 when 3 then concat('password = "', substr(md5(text), 1, 12), '"')
 when 4 then concat('blob ', md5(text)) else 'nothing here' end"""
_EARLIER_TAIL = """case conv_id % 6
 when 0 then concat('key=AKIA', upper(substr(md5(text), 1, 16)))
 when 1 then concat('push with ghp_', substr(concat(md5(role), md5(text)), 1, 36))
 when 2 then 'charge'
 when 3 then concat('password = "', substr(md5(text), 1, 12), '"')
 when 4 then concat('blob ', md5(role)) else concat('secret: "', substr(md5(text), 1, 12), '"') end"""
_CONV_FILE = "concat('conv/', cast(conv_id as varchar(20)), '/', cast(turn as varchar(20)), '.txt')"
_PROJECT_OF_ORDER = "cast(floor(l_orderkey / 4) as bigint)"

VIEWS: dict[str, View] = {
    "fx_files": View("documents", {
        "doc_id": "doc_id",
        "project_id": "doc_id % 60",
        "file": f"concat(source, '/', {_text('doc_id')}, case when doc_id % 4 = 0 then '.ts'"
                " when doc_id % 4 = 1 then '.js' else '.txt' end)",
        "content": "text",
        "size": "n_chars",
    }),
    "fx_planted": View("conversations", {
        "project_id": "conv_id % 60",
        "file": _CONV_FILE,
        "content": f"concat(text, chr(10), {_PLANTED_TAIL})",
    }),
    "fx_project_patterns": View("supplier", {
        "project_id": "s_suppkey % 60",
        "seq": "s_suppkey",
        "name": "concat('Own ', cast(s_suppkey % 6 as varchar(20)), case when s_suppkey % 3 = 0 then ' b' else '' end)",
        "regex": """case s_suppkey % 6 when 0 then '[A-Za-z0-9._]+@[A-Za-z0-9-]+[.][a-z]{2,}'
 when 1 then concat('[', chr(cast(97 + s_suppkey % 26 as int)), 'xyz][a-z]{11,}')
 when 2 then '^[A-Z][a-z]{7,}' when 3 then '(?i)key=akia[0-9a-z]{4}'
 when 4 then concat(chr(92), 'b(?:1|2)[0-9]{0,2}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}', chr(92), 'b')
 else cast(null as varchar(20)) end""",
        "severity": "case s_suppkey % 4 when 0 then 'high' when 1 then 'medium' else 'low' end",
        "entropy": "case when s_suppkey % 2 = 0 then cast(1.5 as double) end",
    }),
    "fx_planted_before": View("conversations", {
        "project_id": "conv_id % 60",
        "file": _CONV_FILE,
        "content": f"concat(text, chr(10), {_EARLIER_TAIL})",
    }),
    "fx_commits": View("orders", {
        "repo": f"concat('repo-', {_text('o_custkey % 50')})",
        "seq": "o_orderkey",
        "hash": f"md5({_ORDER_TEXT})",
        "subject": f"""case o_orderkey % 12
 when 0 then concat('feat(api): add item ', {_ORDER_TEXT})
 when 1 then concat('fix: correct total ', {_ORDER_TEXT})
 when 2 then concat('docs: describe ', {_ORDER_TEXT})
 when 3 then concat('perf(core): speed up ', {_ORDER_TEXT})
 when 4 then concat('chore: tidy ', {_ORDER_TEXT})
 when 5 then concat('Merge branch ', {_ORDER_TEXT})
 when 6 then concat('fix(ui): pad | align ', {_ORDER_TEXT})
 when 7 then concat('note: BREAKING CHANGE in ', {_ORDER_TEXT})
 when 8 then concat('feat!: drop field ', {_ORDER_TEXT})
 when 9 then concat('refactor(db)!: rename ', {_ORDER_TEXT})
 when 10 then concat('test: cover ', {_ORDER_TEXT}) else 'wip' end""",
        "author": f"concat('dev-', {_text('o_custkey')})",
        "commit_date": "cast(o_orderdate as date)",
    }),
    # one repository per customer, so that some have no breaking commit, no fix, or no commit
    "fx_small_commits": View("orders", {
        "repo": f"concat('app-', {_text('o_custkey')})",
        "seq": "o_orderkey",
        "subject": f"""case when o_custkey % 5 = 0 then 'docs: words' when o_custkey % 5 = 1 then 'fix: bug'
 when o_custkey % 5 = 2 and o_orderkey % 2 = 0 then 'feat(x): more' when o_custkey % 5 = 2 then 'fix: less'
 when o_custkey % 5 = 3 and o_orderkey % 9 = 0 then 'feat!: drop' when o_orderkey % 2 = 0 then 'feat: new'
 else concat('fix: it ', {_ORDER_TEXT}) end""",
    }),
    "fx_repos": View("customer", {
        "repo": f"concat('app-', {_text('c_custkey')})",
        "version": f"""concat({_text('c_custkey % 4')}, case when c_custkey % 7 = 3 then '' else
 concat('.', {_text('c_custkey % 10')}, '.', {_text('c_custkey % 6')}) end,
 case when c_custkey % 11 = 0 then '-beta' else '' end)""",
    }),
    "fx_installed": View("part", {
        "seq": "p_partkey",
        "name": f"concat(case when p_partkey % 23 = 0 then 'old-pkg-' else 'pkg-' end, {_text('p_partkey')})",
        "version": f"concat({_text('p_size % 9')}, '.', {_text('p_partkey % 10')}, '.0')",
        "license": """case p_partkey % 17 when 0 then 'MIT' when 1 then 'Apache-2.0' when 2 then 'Apache 2.0'
 when 3 then 'GPLv3' when 4 then 'GPL-2.0' when 5 then 'LGPL-2.1' when 6 then 'BSD' when 7 then 'BSD-2-Clause'
 when 8 then 'ISC' when 9 then 'Unlicense' when 10 then 'CC0-1.0' when 11 then 'UNKNOWN'
 when 12 then cast(null as varchar(20)) when 13 then '' when 14 then 'undefined' when 15 then 'WTFPL'
 else 'MPL-2.0' end""",
    }),
    "fx_manifest": View("lineitem", {
        "project_id": _PROJECT_OF_ORDER,
        "seq": "l_partkey",
        "name": f"concat('pkg-', {_text('l_partkey')})",
        "version_range": f"concat('^', {_text('l_partkey % 5')}, '.0.0')",
        "dep_scope": "case when (l_orderkey + l_partkey) % 3 < 2 then 'prod' else 'dev' end",
    }, distinct=True),
    "fx_manifest_json": View("orders", {
        "project_id": "o_orderkey",
        "manifest_json": f"""concat('{{"dependencies":{{"core":"^1.0.0","pkg-', {_text('o_custkey')}, '":"^',
 {_text('o_custkey % 5')}, '.0.0"}},"devDependencies":{{"', case when o_orderkey % 3 = 0 then 'core' else 'lint' end,
 '":"~2.', {_text('o_orderkey % 9')}, '.0"}}}}')""",
    }),
    "fx_vulns": View("lineitem", {
        "project_id": _PROJECT_OF_ORDER,
        "seq": "(l_orderkey % 4) * 8 + l_linenumber",
        "package": f"concat('pkg-', {_text('l_partkey')})",
        "version": f"concat({_text('l_linenumber')}, '.0.0')",
        "severity": """case when floor(l_orderkey / 4) % 5 = 0 and l_partkey % 7 = 0 then 'CRITICAL'
 when floor(l_orderkey / 4) % 5 <= 1 and l_partkey % 7 = 1 then 'high'
 when floor(l_orderkey / 4) % 5 = 2 and l_partkey % 21 = 1 then 'High'
 when floor(l_orderkey / 4) % 5 <= 3 and l_partkey % 7 in (2, 3) then 'medium'
 when l_partkey % 7 = 4 then 'info' when l_partkey % 49 = 5 then cast(null as varchar(20)) else 'low' end""",
        "fixed_in": f"case when l_returnflag = 'R' then concat({_text('l_linenumber + 1')}, '.0.0') end",
        "advisory_id": "l_orderkey",
    }),
    # one audit document per project
    "fx_audit_json": View("fx_vulns", {
        "project_id": "advisory_id * 8 + seq % 8",
        "package": "package",
        "audit_json": """case when severity is null then '{"metadata":{}}' else
 concat('{"vulnerabilities":{"', package, '":{"severity":"', severity, '","version":"', version,
 '","fixedIn":"', coalesce(fixed_in, ''), '","cvss":{"score":', case when seq % 2 = 0 then '7.5' else '"n/a"' end,
 ',"vector":"AV:N"},"cwe":["CWE-79"]}', case when seq % 3 = 0 then
 ',"shared-lib":{"id":"A-1","title":"Prototype pollution","severity":"HIGH"}' else '' end, '}}') end""",
    }, spread=True),
    "fx_events": View("events", {
        "seq": "event_id",
        "type": """case event_type when 'click' then 'scan' when 'view' then 'audit' when 'signup' then 'login'
 when 'purchase' then 'publish' else 'error' end""",
        "ts": "ts",
        "actor": f"concat('user-', {_text('user_id')})",
        "value": "value",
        "details": f"""concat('{{"secrets":', {_text('event_id % 3')}, ',"vulnerabilities":', {_text('event_id % 5')},
 ',"licenseIssues":', {_text('event_id % 2')}, '}}')""",
    }),
    "fx_metrics": View("events", {
        "seq": "event_id",
        "ts": "ts",
        "type": """case event_type when 'click' then 'cpu' when 'view' then 'memory' when 'signup' then 'disk'
 when 'purchase' then 'process' else 'custom' end""",
        "value": "value",
        "unit": "case event_type when 'click' then '%' when 'purchase' then 'seconds' else 'bytes' end",
        "source": f"concat('host-', {_text('user_id % 20')})",
    }),
    "fx_heap": View("events", {
        "seq": "event_id",
        "ts": "ts",
        "source": f"concat('host-', {_text('user_id')})",
        "heap_bytes": "cast(round(value * 100) as bigint) * 100000",
    }),
    "fx_perf_updates": View("events", {
        "seq": "event_id",
        "ts": "ts",
        "source": f"concat('host-', {_text('user_id % 20')})",
        "response_time": "case when event_type = 'click' then value end",
        "throughput": "case when event_type in ('click', 'view') then value * 2 end",
        "error_rate": "case when event_type = 'signup' then value / 4 end",
        "availability": "case when event_type = 'purchase' then 100 - value / 8 end",
    }),
    "fx_alert_actions": View("events", {
        "seq": "event_id",
        "alert_id": "event_id - user_id % 5",
        "action": """case when user_id % 3 = 0 then 'acknowledge' when user_id % 3 = 1 then 'resolve'
 else 'comment' end""",
        "actor": f"concat('user-', {_text('user_id')})",
        "ts": "ts",
    }),
    "fx_scans": View("events", {
        "project_id": "user_id",
        "scan_id": "event_id",
        "scan_ts": "ts",
        "version": f"concat('1.', {_text('event_id % 30')}, '.0')",
        "severity": """case event_type when 'click' then 'critical' when 'view' then 'high'
 when 'signup' then 'medium' else 'low' end""",
    }),
    "fx_snapshots": View("events", {
        "cache_key": f"concat('options-', {_text('user_id')})",
        "snapshot_id": "event_id",
        "fetched_at": "ts",
    }),
    "fx_deployments": View("orders", {
        "seq": "o_orderkey",
        "name": f"concat('app-', {_text('o_custkey % 40')})",
        "version": f"concat('1.', {_text('o_orderkey % 30')}, '.0')",
        "environment": """case o_orderkey % 3 when 0 then 'development' when 1 then 'staging'
 else 'production' end""",
        "status": "case o_orderstatus when 'F' then 'success' when 'P' then 'failed' else 'pending' end",
        "created_at": "o_orderdate",
        "completed_at": """case when o_orderstatus = 'F' then o_orderdate + interval '5' minute
 when o_orderstatus = 'P' then o_orderdate + interval '9' minute end""",
    }),
    "fx_requests": View("orders", {
        "deployment_id": "o_orderkey",
        "name": f"concat('app-', {_text('o_custkey % 40')})",
        "environment": """case o_orderkey % 7 when 0 then 'development' when 1 then 'staging' when 2 then 'staging'
 when 3 then 'qa' else 'production' end""",
        "strategy": """case o_orderkey % 5 when 0 then 'rolling' when 1 then 'big-bang'
 when 2 then cast(null as varchar(20)) when 3 then '' else 'canary' end""",
        "auto_approve": "o_orderkey % 11 = 0",
    }),
    "fx_approval_actions": View("lineitem", {
        "deployment_id": "l_orderkey",
        "approver": """case when l_partkey % 4 = 0 then 'dev-lead' when l_partkey % 4 = 1 then 'ops-lead'
 when l_partkey % 4 = 2 then 'visitor' else 'dev-lead' end""",
        "action": "case when l_partkey % 19 = 0 then 'reject' else 'approve' end",
        "ts": "l_shipdate",
        "seq": "l_partkey * 10 + l_linenumber",
    }),
    "fx_tests": View("lineitem", {
        "run_id": "l_orderkey",
        "test_no": "l_linenumber",
        "framework": """case l_suppkey % 4 when 0 then 'jest' when 1 then 'cypress' when 2 then 'playwright'
 else 'artillery' end""",
        "environment": "case l_partkey % 2 when 0 then 'local' else 'docker' end",
        "status": "case l_returnflag when 'R' then 'failed' else 'passed' end",
        "duration_ms": "l_quantity * 10",
    }),
    "fx_issues": View("orders", {
        "issue_id": "o_orderkey",
        "priority": """case o_orderpriority when '1-URGENT' then 'Urgent' when '2-HIGH' then 'High'
 when '3-MEDIUM' then 'Medium' when '5-LOW' then 'Low' else 'No priority' end""",
        "label": "case o_orderkey % 3 when 0 then 'security' when 1 then 'dependency' else 'license' end",
        "created_at": "o_orderdate",
    }),
    "fx_label_requests": View("orders", {
        "issue_id": "o_orderkey",
        "pos": "o_orderkey % 3",
        "name": """case o_orderpriority when '1-URGENT' then 'SECURITY' when '2-HIGH' then 'Dependency'
 when '3-MEDIUM' then 'license' else 'unlisted' end""",
    }),
    "fx_label_list": View("nation", {
        "label_id": f"concat('label-', {_text('n_nationkey')})",
        "pos": "n_nationkey",
        "name": """case n_nationkey % 4 when 0 then 'security' when 1 then 'Dependency' when 2 then 'LICENSE'
 else n_name end""",
    }),
    "fx_logs": View("conversations", {
        "deployment_id": "conv_id % 40",
        "seq": "conv_id * 1000 + turn",
        "ts": "conv_id * 1000 + turn",
        "level": "case role when 'system' then 'error' when 'assistant' then 'warn' else 'info' end",
        "message": "text",
    }),
    "fx_deploy_logs": View("lineitem", {
        "deployment_id": "l_suppkey",
        "seq": "l_orderkey * 10 + l_linenumber",
        "ts": "l_shipdate",
        "level": "case l_returnflag when 'R' then 'error' when 'A' then 'warn' else 'info' end",
        "message": f"concat('step ', {_text('l_orderkey')}, ' part ', {_text('l_partkey')}, ' line ', {_text('l_linenumber')})",
    }),
    "fx_publishes": View("events", {
        "seq": "event_id",
        "event": """case event_type when 'click' then 'scan' when 'purchase' then 'publish'
 when 'signup' then 'unpublish' when 'view' then 'version' else 'rollback' end""",
        "package": f"concat('pkg-', {_text('user_id')})",
        "version": f"concat('1.', {_text('event_id % 30')}, '.0')",
        "ts": "ts",
        "data": "props",
    }),
    "fx_webhooks": View("nation", {
        "url": f"concat('https://hooks.example/', {_text('n_nationkey')})",
        "events": """split(case n_nationkey % 3 when 0 then 'publish,unpublish' when 1 then 'scan'
 else 'version,rollback,version' end, ',')""",
    }),
    "fx_deliveries": View("events", {
        "url": f"concat('https://hooks.example/', {_text('user_id')})",
        "delivered": "event_type <> 'error'",
    }),
    "fx_downloads": View("lineitem", {
        "name": f"concat('pkg-', {_text('l_partkey')})",
        "downloads": "cast(l_quantity as bigint) * 100",
    }),
    "fx_git": View("supplier", {
        "project_id": "s_suppkey",
        "is_clean": "s_suppkey % 4 <> 0",
    }),
    "fx_ci": View("supplier", {
        "project_id": "s_suppkey",
        "is_passing": "s_acctbal > 0",
    }),
    "fx_projects": View("supplier", {"project_id": "s_suppkey"}),
    "fx_env_updates": View("customer", {
        "seq": "c_custkey",
        "op": "case when c_custkey % 4 = 1 then 'add' else 'update' end",
        "name": """case c_custkey % 7 when 0 then 'staging' when 1 then 'production' when 2 then 'qa-eu'
 else concat('env-', cast(c_nationkey as varchar(20))) end""",
        "type": "case when c_custkey % 5 < 2 then concat('test-', cast(c_custkey as varchar(20))) end",
        "deployment_strategy": "case c_custkey % 3 when 0 then 'rolling' when 1 then 'canary' end",
        "auto_approve": "case c_custkey % 6 when 0 then true when 1 then false end",
        "required_approvers": """case c_custkey % 8 when 0 then split('qa-lead,ops-lead', ',')
 when 1 then split(concat('lead-', cast(c_custkey as varchar(20))), ',') end""",
    }),
    "fx_cutoffs": View("events", {
        "project_id": "user_id",
        "cut_id": "event_id",
        "since": "case event_id % 3 when 0 then ts when 1 then ts - interval '7' hour else ts - interval '40' day end",
    }),
    "fx_scan_runs": View("events", {
        "project_id": "user_id % 7",
        "scan_id": "cast(extract(day from ts) as bigint)",
        "scan_ts": "date_trunc('day', ts)",
    }, distinct=True),
    "fx_scan_findings": View("events", {
        "project_id": "user_id % 7",
        "scan_id": "cast(extract(day from ts) as bigint)",
        "file": "concat('src/', event_type, '.ts')",
        "pattern_name": "case when event_id % 2 = 0 then 'AWS Access Key' else 'GitHub Token' end",
        "value": f"concat('key-', {_text('user_id % 3')})",
    }, where="event_id % 5 <> 0 and event_type <> 'error'"),
    "fx_labelled_metrics": View("events", {
        "seq": "event_id",
        "name": "event_type",
        "labels_json": f"""case when event_id % 3 = 0 then concat('{{"name":"own-', {_text('user_id')}, '"}}')
 else concat('{{"host":"h', {_text('user_id')}, '"}}') end""",
    }),
}

# The same requests with the time they were made.
VIEWS["fx_request_events"] = View("orders", {**VIEWS["fx_requests"].columns, "ts": "o_orderdate"})


def _lineage(name: str) -> list[str]:
    base = VIEWS[name].base
    return (_lineage(base) if base in VIEWS else []) + [name]


# Into how many tasks per core the rows of a ``spread`` view are dealt.
TASKS_PER_CORE = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(base: DataFrame, view: View) -> DataFrame:
    """The columns of a view over its base, batch or stream."""
    rows = base if view.where is None else base.where(view.where)
    rows = rows.selectExpr(*[f"{expr} as {name}" for name, expr in view.columns.items()])
    return rows.distinct() if view.distinct else rows


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    configure(spark)
    chain = _lineage(name)
    rows = table(spark, sf_dir, VIEWS[chain[0]].base)
    if VIEWS[name].spread:
        rows = rows.repartition(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    for step in chain:
        rows = derive(rows, VIEWS[step])
    return rows


def _sql(name: str) -> str:
    view = VIEWS[name]
    columns = ", ".join(f"{expr} as {alias}" for alias, expr in view.columns.items())
    where = "" if view.where is None else f" where {view.where}"
    return f"select {'distinct ' if view.distinct else ''}{columns} from {view.base}{where}"


def with_views(*names: str) -> str:
    """The views as the head of a SQL query: ``with a as (...), b as (...)``."""
    needed: list[str] = []
    for name in names:
        needed += [n for n in _lineage(name) if n not in needed]
    return "with " + ",\n".join(f"{n} as ({_sql(n)})" for n in needed)
