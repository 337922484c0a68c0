"""Event history, earlier findings, outbox, exports."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spark's own default writes milliseconds only.
TIME_FORMATS = {
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}
EVENT_SCHEMA = "seq bigint, type string, ts timestamp_ntz, actor string, value double, details string"
FINDING_SCHEMA = (
    "file string, line int, column int, value string, pattern_name string, severity string,"
    " entropy double, context string"
)


def read_event_history(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The event history; a missing or unreadable one counts as empty.

    ``multi_line`` reads files that hold one JSON array instead of one event
    per line.
    """
    reader = spark.read.schema(EVENT_SCHEMA).option("mode", "DROPMALFORMED")
    try:
        return reader.option("multiLine", str(multi_line).lower()).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], EVENT_SCHEMA)


def append_events(events: DataFrame, path: str, now=None) -> None:
    """Append events, stamped with the time of writing, one folder per day."""
    stamp = F.current_timestamp() if now is None else now
    stamped = events.withColumn("ts", stamp).withColumn("date", F.to_date("ts"))
    stamped.write.mode("append").partitionBy("date").parquet(path)


def append_batch(events: DataFrame, path: str, batch_id: str, now=None) -> None:
    """Append events, stamped as in ``append_events``, as one batch with an id of the caller.

    Each batch has a folder of its own and replaces it, so one that is written again, on another day too, adds
    nothing. The history reads back with its column ``batch``.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch_id):
        raise ValueError(f"a batch id is letters, digits, dots and dashes: {batch_id!r}")
    stamp = F.current_timestamp() if now is None else now
    events.withColumn("ts", stamp).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_baseline(spark: SparkSession, path: str, project_type: str | None = "bigint") -> DataFrame:
    """The findings of an earlier scan; ``project_type`` is None for one written without projects."""
    project = f"project_id {project_type}, " if project_type else ""
    return spark.read.schema(project + FINDING_SCHEMA).json(path)


def write_baseline(findings: DataFrame, path: str) -> None:
    names = [part.split()[0] for part in FINDING_SCHEMA.split(", ")]
    project = ["project_id"] if "project_id" in findings.columns else []
    findings.select(*project, *[n.strip() for n in names]).write.mode("overwrite").json(path)


def export_table(df: DataFrame, path: str, format: str) -> None:
    """Write a table as ``json`` or ``csv``, times with all their digits."""
    if format not in ("json", "csv"):
        raise ValueError(f"unknown format {format!r}")
    writer = df.write.mode("overwrite").options(**TIME_FORMATS)
    if format == "csv":
        writer = writer.option("header", "true")
    writer.format(format).save(path)


# Suites in an XML file: one task reads a file whole, so none may grow with the table.
XML_SUITES = 200_000


def export_test_report(suites: DataFrame, path: str, format: str) -> None:
    """Write suites as JSON rows or as JUnit-style XML, the latter in files of at most ``XML_SUITES``."""
    if format == "json":
        suites.write.mode("overwrite").json(path)
    elif format == "xml":
        attributes = suites.select(
            F.col("run_id").alias("_id"),
            F.col("name").alias("_name"),
            F.col("total_tests").alias("_tests"),
            F.col("failed_tests").alias("_failures"),
            F.col("skipped_tests").alias("_skipped"),
            F.col("duration_ms").alias("_time"),
            F.col("status"),
        )
        attributes.write.format("xml").mode("overwrite").option("rootTag", "testsuites").option(
            "rowTag", "testsuite"
        ).option("maxRecordsPerFile", str(XML_SUITES)).save(path)
    else:
        raise ValueError(f"unknown format {format!r}")


XML_SUITE_SCHEMA = (
    "_id bigint, _name string, _tests bigint, _failures bigint, _skipped bigint, _time double,"
    " status string"
)


def read_test_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "testsuite").schema(XML_SUITE_SCHEMA).load(path)


def _payload() -> Column:
    """A webhook event ``_stamped`` as JSON: kind, package, version, time and the data as an object.

    Data that is no JSON becomes a JSON string, absent data an empty object.
    """
    head = F.to_json(F.struct("event", "package", "version", "timestamp"))
    quoted = F.to_json(F.struct(F.col("data").alias("d")))
    text = F.substring(quoted, F.lit(6), F.length(quoted) - 6)
    data = F.when(F.col("data").isNull(), "{}").when(F.try_parse_json("data").isNotNull(), F.col("data")).otherwise(text)
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"data":'), data, F.lit("}"))


def _stamped(events: DataFrame) -> DataFrame:
    return events.withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def webhook_outbox(events: DataFrame, urls: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One payload per event and webhook; the URLs come from configuration. ``keep`` names columns of the events that stay in front."""
    return _stamped(events).select(
        *keep, "event", "package", "version", "ts", _payload().alias("payload"),
        F.explode(F.array(*[F.lit(u) for u in urls])).alias("url"),
    )


def subscription_join(events: DataFrame, webhooks: DataFrame) -> DataFrame:
    """One payload per event and webhook that subscribed to its kind.

    ``webhooks(url, events array)`` is opened to one row per kind, so the join
    is on equal kinds.
    """
    kinds = webhooks.select("url", F.explode(F.array_distinct("events")).alias("event"))
    return _stamped(events).join(kinds, "event").select(
        "event", "package", "version", "ts", _payload().alias("payload"), "url"
    )


def write_outbox(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
