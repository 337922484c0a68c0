"""Wall times of the headline queries; prints one JSON line.

Every query writes its whole result to the ``noop`` sink, once to warm up and
then three times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from release_guard import catalog, fixtures
from release_guard.session import local_session

HEADLINE = {
    "secret_scan": "documents",
    "scan_documents": "documents",
    "version_analysis": "orders",
    "changelog_sections": "orders",
    "vuln_summary": "lineitem",
    "vuln_recommendations": "lineitem",
    "license_summary": "lineitem",
    "audit_licenses": "lineitem",
    "threshold_join": "events",
    "performance_state": "events",
    "suite_summary": "lineitem",
    "report_summary": "lineitem",
    "rollback_target": "orders",
    "deployment_state": "lineitem",
    "unpublish_impact": "lineitem",
    "security_workflow": "lineitem",
}
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    queries = catalog.queries()
    times: dict[str, float] = {}
    rates: dict[str, int] = {}
    for name, source in HEADLINE.items():
        runs = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 4)
        rates[name] = round(fixtures.table(spark, sf_dir, source).count() / times[name])
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "input_rows_per_sec": rates,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cores": cores,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
