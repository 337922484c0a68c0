"""Test run queries."""

from __future__ import annotations

from ..fixtures import frame, with_views
from ..operators import test_runs as t

RUN = 17


def results(sp, sf):
    return frame(sp, sf, "fx_tests")


def _planned(sp, sf):
    """The suites planned for each run, with those that did not start left pending."""
    runs = results(sp, sf).select("run_id").distinct()
    return t.suite_matrix(
        runs, ["jest", "cypress", "playwright", "artillery"], ["local", "docker", "cloud"],
        only_environments=["local", "docker"],
    )


QUERIES = {
    "suite_matrix": _planned,
    "suite_summary": lambda sp, sf: t.suite_summary(results(sp, sf)),
    "report_summary": lambda sp, sf: t.report_summary(results(sp, sf)),
    "latest_reports": lambda sp, sf: t.latest_reports(t.report_summary(results(sp, sf)), 10),
    "suites_of_report": lambda sp, sf: t.suites_of_report(results(sp, sf), RUN),
}

TESTS = with_views("fx_tests")
COUNTS = """count(*) as total_tests, count(*) filter (status = 'passed') as passed_tests,
 count(*) filter (status = 'failed') as failed_tests, count(*) filter (status = 'skipped') as skipped_tests,
 sum(duration_ms) as duration_ms"""
STATUS = "case when failed_tests > 0 then 'failed' else 'passed' end as status"
SUITES = f"""select *, concat(framework, '-', environment) as name, {STATUS}
 from (select run_id, framework, environment, {COUNTS} from fx_tests group by all)"""
REPORTS = f"""select *, {STATUS} from (select run_id, count(distinct (framework, environment)) as total_suites, {COUNTS}
 from fx_tests group by run_id)"""

ORACLES = {
    "suite_matrix": f"""{TESTS} select run_id, framework, environment, concat(framework, '-', environment) as name,
 'pending' as status from (select distinct run_id from fx_tests),
 (select unnest(['jest', 'cypress', 'playwright', 'artillery']) as framework),
 (select unnest(['local', 'docker']) as environment)""",
    "suite_summary": f"{TESTS} {SUITES}",
    "report_summary": f"{TESTS} {REPORTS}",
    "latest_reports": f"{TESTS} select * from ({REPORTS}) order by run_id desc limit 10",
    "suites_of_report": f"{TESTS} select * from ({SUITES}) where run_id = {RUN}",
}
