"""Reader and writer queries; what is written goes to the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import frame, with_views
from ..functions.scoring import cvss_or_null
from ..operators import delivery
from ..operators import secrets as s
from ..operators import test_runs as t
from ..session import scratch_dir
from ..sources import files, history
from ..sources.manifests import AUDIT_SCHEMA, explode_manifest, parse_audit_json
from . import secrets as sec
from . import test_runs as tests
from . import vulnerabilities as vul

INCLUDE, EXCLUDE, MAX_SIZE = ["src*/**"], ["src1*/*.ts", "**/*7.js"], 3000
URLS = ["https://hooks.example/a", "https://hooks.example/b", "https://hooks.example/c"]
STAMP = "2024-02-01 08:00:00"


def _log_lines(sp, sf):
    line = F.concat_ws("|", "hash", "subject", "author", F.col("commit_date").cast("string"), F.lit("HEAD"))
    short = F.when(F.col("seq") % 10 == 0, F.substring_index(line, "|", 2)).otherwise(line)
    return frame(sp, sf, "fx_commits").select("seq", short.alias("line"))


def _git_log_file(sp, sf):
    """The log as a text file, read back as lines and parsed."""
    path = scratch_dir(sp, "git-log")
    _log_lines(sp, sf).select("line").write.text(path)
    return files.parse_git_log(files.read_git_log(sp, path))


def _audit(sp, sf):
    rows = parse_audit_json(frame(sp, sf, "fx_audit_json").select("project_id", "audit_json"), vul.AUDIT_TIME)
    return rows.select(
        "project_id", "seq", "id", "title", "description", "severity", "package", "version", "fixed_in",
        F.array_join("cwe", ",").alias("cwe"), F.col("cvss.score").alias("cvss_score"),
        F.col("cvss.vector").alias("cvss_vector"), F.size("refs").alias("refs"), "advisory",
    )


def _cvss(sp, sf):
    doc = F.from_json("audit_json", AUDIT_SCHEMA)
    cvss = cvss_or_null(F.try_element_at(doc["vulnerabilities"], F.col("package"))["cvss"])
    return frame(sp, sf, "fx_audit_json").select("project_id", "package", cvss["score"].alias("score"))


def _event_history(sp, sf):
    path = scratch_dir(sp, "history")
    history.export_table(frame(sp, sf, "fx_events"), path, "json")
    return history.read_event_history(sp, path)


def _appended(sp, sf):
    path = scratch_dir(sp, "events")
    now = F.lit(STAMP).cast("timestamp_ntz")
    events = frame(sp, sf, "fx_events")
    history.append_events(events.filter(F.col("type") == "scan"), path, now)
    history.append_events(events.filter(F.col("type") != "scan"), path, now)
    return sp.read.parquet(path)


def _baseline(sp, sf):
    path = scratch_dir(sp, "baseline")
    history.write_baseline(sec.scan_before(sp, sf), path)
    return s.secret_diff(sec.scan_planted(sp, sf), history.read_baseline(sp, path)).drop("project_id")


def _export(sp, sf):
    path = scratch_dir(sp, "export")
    metrics = frame(sp, sf, "fx_metrics")
    history.export_table(metrics, path, "csv")
    schema = "seq bigint, ts timestamp_ntz, type string, value double, unit string, source string"
    return sp.read.schema(schema).option("header", "true").csv(path)


def _export_json(sp, sf):
    path = scratch_dir(sp, "export")
    events = frame(sp, sf, "fx_events")
    history.export_table(events, path, "json")
    return sp.read.schema(events.schema).json(path)


def _test_report(sp, sf):
    path = scratch_dir(sp, "report")
    history.export_test_report(t.suite_summary(frame(sp, sf, "fx_tests")), path, "xml")
    return history.read_test_report(sp, path).select(
        F.col("_id").alias("run_id"), F.col("_name").alias("name"), F.col("_tests").alias("tests"),
        F.col("_failures").alias("failures"), F.col("_skipped").alias("skipped"),
        F.col("_time").alias("duration_ms"), "status",
    )


def _appended_once(sp, sf):
    """Two batches, the first written again a day later."""
    path = scratch_dir(sp, "batches")
    stamp = F.lit(STAMP).cast("timestamp_ntz")
    events = frame(sp, sf, "fx_events")
    scans = events.filter(F.col("type") == "scan")
    history.append_batch(scans, path, "b1", stamp)
    history.append_batch(events.filter(F.col("type") != "scan"), path, "b2", stamp)
    history.append_batch(scans, path, "b1", stamp + F.expr("interval 1 day"))
    return sp.read.parquet(path)


def _test_report_json(sp, sf):
    path = scratch_dir(sp, "report")
    suites = t.suite_summary(frame(sp, sf, "fx_tests"))
    history.export_test_report(suites, path, "json")
    return sp.read.schema(suites.schema).json(path)


def _deliveries(sp, sf):
    """Four rounds of sending, an hour apart, the second one run twice; one URL never answers."""
    path = scratch_dir(sp, "attempts")
    # An event without kind, package, version or time is not sent.
    events = frame(sp, sf, "fx_publishes").dropna(subset=["event", "package", "version", "ts"])
    outbox = history.webhook_outbox(events.withColumn("event_id", F.col("seq")), URLS, keep=["event_id"])
    number = F.element_at(F.array(*[F.lit(i) for i in range(len(URLS))]), F.array_position(F.array(*[F.lit(u) for u in URLS]), F.col("url")).cast("int"))

    def send(rows):
        answers = (F.col("event_id") + F.col("attempt") * 2 + number) % 4 == 0
        return rows.withColumn("ok", answers & (number != 2))

    start = F.lit(STAMP).cast("timestamp_ntz")
    for name, hours in [("r1", 0), ("r2", 1), ("r2", 1), ("r3", 2), ("r4", 3)]:
        delivery.deliver_round(outbox, path, name, start + F.expr(f"interval {hours} hours"), send, most_tries=4)
    return delivery.delivery_state(outbox, delivery.read_attempts(sp, path), most_tries=4)


QUERIES = {
    "read_files": lambda sp, sf: files.read_files(
        sp, frame(sp, sf, "fx_files"), INCLUDE, EXCLUDE, MAX_SIZE
    ).drop("content"),
    "parse_git_log": lambda sp, sf: files.parse_git_log(_log_lines(sp, sf)),
    "read_git_log": _git_log_file,
    "parse_audit_json": _audit,
    "cvss_or_null": _cvss,
    "explode_manifest": lambda sp, sf: explode_manifest(frame(sp, sf, "fx_manifest_json"), include_dev=True),
    "explode_manifest_prod": lambda sp, sf: explode_manifest(frame(sp, sf, "fx_manifest_json")),
    "read_event_history": _event_history,
    "append_events": _appended,
    "read_baseline": _baseline,
    "append_batch": _appended_once,
    "export_test_report_json": _test_report_json,
    "delivery_state": _deliveries,
    "delivery_rate": lambda sp, sf: delivery.delivery_rate(_deliveries(sp, sf)),
    "export_table": _export,
    "export_table_json": _export_json,
    "export_test_report": _test_report,
    "webhook_outbox": lambda sp, sf: history.webhook_outbox(frame(sp, sf, "fx_publishes"), URLS),
    "subscription_join": lambda sp, sf: history.subscription_join(
        frame(sp, sf, "fx_publishes"), frame(sp, sf, "fx_webhooks")
    ),
}

LOG = f"""{with_views('fx_commits')}, log as (select seq, string_split(case when seq % 10 = 0 then concat(hash, '|',
 string_split(subject, '|')[1]) else concat_ws('|', hash, subject, author, cast(commit_date as varchar), 'HEAD') end, '|') as f
 from fx_commits)"""
LOG_COLUMNS = """coalesce(f[1], '') as hash, coalesce(f[2], '') as subject, coalesce(f[3], '') as author,
 coalesce(f[4], '') as commit_date"""
PAYLOAD = """concat('{"event":"', event, '","package":"', package, '","version":"', version, '","timestamp":"',
 strftime(ts, '%Y-%m-%dT%H:%M:%S.%g'), 'Z","data":', data, '}') as payload"""
# The first try of four that succeeds, an hour between two tries; the third URL never answers.
DELIVERIES = f"""{with_views('fx_publishes')}, urls(url, number) as (values {', '.join(f"('{u}', {i})" for i, u in enumerate(URLS))}),
 firsts as (select seq as event_id, url, number, list_filter([1, 2, 3, 4], lambda k: number <> 2 and (seq + k * 2 + number) % 4 = 0)[1] as k
 from fx_publishes, urls),
 states as (select event_id, url, cast(coalesce(k, 4) as bigint) as tries, case when k is null then 'failed' else 'delivered' end as status,
 timestamp '{STAMP}' + to_hours(k - 1) as delivered_at, cast(null as timestamp) as next_try_at from firsts)"""
EVENTS = with_views("fx_events")
MANIFEST = with_views("fx_manifest_json")
PROD = """prod as (select project_id, unnest(json_keys(manifest_json, '$.dependencies')) as name,
 generate_subscripts(json_keys(manifest_json, '$.dependencies'), 1) as pos, manifest_json from fx_manifest_json)"""
DEV = PROD.replace("dependencies", "devDependencies").replace("prod as", "dev as")


def _versions(scope: str, key: str) -> str:
    return f"""select project_id, name, json_extract_string(manifest_json, concat('$.{key}."', name, '"')) as version_range,
 '{scope}' as dep_scope, pos from {scope}"""


ORACLES = {
    "read_files": f"""{with_views('fx_files')} select doc_id, project_id, file, size from fx_files
 where file not like 'src1%.ts' and file not like '%7.js' and size <= {MAX_SIZE}""",
    "parse_git_log": f"{LOG} select seq, {LOG_COLUMNS} from log",
    "read_git_log": f"{LOG} select {LOG_COLUMNS} from log",
    "parse_audit_json": f"""{vul.AUDIT_DOCS}, b as (select *,
 json_extract_string(j, '$.severity') as raw, json_extract_string(j, '$.cvss.vector') as vector,
 case when json_type(j, '$.cvss.score') in ('DOUBLE', 'UBIGINT', 'BIGINT') then cast(json_extract(j, '$.cvss.score') as double) end as score
 from a where j is not null)
 select project_id, cast(row_number() over (partition by rid order by seq) - 1 as bigint) as seq,
 coalesce(json_extract_string(j, '$.id'), concat('npm-', package, '-{vul.AUDIT_TIME}')) as id,
 coalesce(json_extract_string(j, '$.title'), concat('Vulnerability in ', package)) as title,
 'No description available' as description, {vul.MAP.replace('severity', 'raw')} as severity, package,
 coalesce(json_extract_string(j, '$.version'), 'unknown') as version, json_extract_string(j, '$.fixedIn') as fixed_in,
 case when package = 'shared-lib' then '' else 'CWE-79' end as cwe, score as cvss_score,
 case when score is not null then vector end as cvss_vector, cast(0 as int) as refs, cast(null as varchar) as advisory
 from b""",
    "cvss_or_null": f"""{with_views('fx_audit_json')} select project_id, package,
 case when contains(audit_json, '"score":7.5') then cast(7.5 as double) end as score from fx_audit_json""",
    "explode_manifest": f"""{MANIFEST}, {PROD}, {DEV}, d as ({_versions('dev', 'devDependencies')}),
 p as ({_versions('prod', 'dependencies')}),
 merged as (select p.project_id, p.name, coalesce(d.version_range, p.version_range) as version_range,
 case when d.name is null then 'prod' else 'dev' end as dep_scope, 1 as part, p.pos
 from p left join d on d.project_id = p.project_id and d.name = p.name
 union all select project_id, name, version_range, dep_scope, 2, pos from d
 where (project_id, name) not in (select (project_id, name) from p))
 select project_id, name, version_range, dep_scope,
 cast(row_number() over (partition by project_id order by part, pos) - 1 as bigint) as seq from merged""",
    "explode_manifest_prod": f"""{MANIFEST}, {PROD} select * exclude (pos), cast(pos - 1 as bigint) as seq
 from ({_versions('prod', 'dependencies')})""",
    "read_event_history": f"{EVENTS} select * from fx_events",
    "append_events": f"""{EVENTS} select * replace (timestamp '{STAMP}' as ts), date '{STAMP[:10]}' as date
 from fx_events""",
    "append_batch": f"""{EVENTS} select * replace (case when type = 'scan' then timestamp '{STAMP}' + interval 1 day
 else timestamp '{STAMP}' end as ts), case when type = 'scan' then 'b1' else 'b2' end as batch from fx_events""",
    "export_test_report_json": tests.ORACLES["suite_summary"],
    "delivery_state": f"{DELIVERIES} select * from states",
    "delivery_rate": f"""{DELIVERIES} select url, count(*) as deliveries, count(*) filter (status = 'delivered') as delivered,
 count(*) filter (status = 'failed') as failed, count(*) filter (status = 'waiting') as waiting,
 count(*) filter (status = 'new') as new, avg(case when status in ('delivered', 'failed') then
 case when status = 'delivered' then 1 else 0 end end) as success_rate, cast(sum(tries) as bigint) as tries from states group by url""",
    "read_baseline": f"{sec.DIFF} select * from diff",
    "export_table": f"{with_views('fx_metrics')} select * from fx_metrics",
    "export_table_json": f"{EVENTS} select * from fx_events",
    "export_test_report": f"""{with_views('fx_tests')} select run_id, concat(framework, '-', environment) as name,
 count(*) as tests, count(*) filter (status = 'failed') as failures, cast(0 as bigint) as skipped,
 sum(duration_ms) as duration_ms, case when bool_or(status = 'failed') then 'failed' else 'passed' end as status
 from fx_tests group by run_id, framework, environment""",
    "webhook_outbox": f"""{with_views('fx_publishes')} select event, package, version, ts, {PAYLOAD},
 unnest([{', '.join("'" + u + "'" for u in URLS)}]) as url from fx_publishes""",
    "subscription_join": f"""{with_views('fx_publishes', 'fx_webhooks')} select event, package, version, ts, {PAYLOAD}, url
 from fx_publishes join (select distinct url, unnest(events) as event from fx_webhooks) using (event)""",
}
