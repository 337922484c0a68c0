"""Streams of metrics, alerts, events and files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from .. import rules
from ..operators.monitoring import threshold_join
from ..plans.scan import scan_lines, secret_scan
from ..rules import SecretPattern
from ..sources.history import webhook_outbox


def read_table_stream(
    spark: SparkSession, path: str, schema, files_per_trigger: int | None = None
) -> DataFrame:
    """Parquet files as a stream, new files as they land."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    return reader.parquet(path)


def with_event_time(stream: DataFrame, column: str = "ts") -> DataFrame:
    """Zone-less times as UTC instants; watermarks need the latter."""
    return stream.withColumn(column, F.col(column).cast("timestamp"))


def metrics_with_retention(
    stream: DataFrame, days: int = rules.METRIC_RETENTION_DAYS, key: str = "seq"
) -> DataFrame:
    """Each metric once; rows older than the retention are late and dropped.

    The keys already seen are forgotten when the watermark passes them.
    """
    return (
        with_event_time(stream)
        .withWatermark("ts", f"{days} days")
        .dropDuplicatesWithinWatermark([key])
    )


def alert_stream(stream: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Alerts as metrics arrive, one per breach; stateless."""
    return threshold_join(stream, thresholds)


def stats_stream(events: DataFrame) -> DataFrame:
    """Running count per event type, for output mode ``complete``."""
    return events.groupBy("type").agg(F.count("*").alias("events"))


def metric_window_stream(
    stream: DataFrame, interval: str = rules.METRIC_INTERVAL, delay: str = "1 minute"
) -> DataFrame:
    """Figures per type and interval, emitted once the watermark closes the interval."""
    return (
        with_event_time(stream)
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", interval), "type")
        .agg(
            F.round(F.avg("value"), 6).alias("avg_value"),
            F.max("value").alias("max_value"),
            F.count("*").alias("samples"),
        )
        .select(
            F.col("window.start").alias("window_start"), "type", "avg_value", "max_value", "samples"
        )
    )


def scan_stream(
    files: DataFrame, patterns: Sequence[SecretPattern] = tuple(rules.DEFAULT_PATTERNS)
) -> DataFrame:
    """Findings in new files as they land; stateless."""
    return secret_scan(files, patterns)


def scan_folder_batch(
    path: str, patterns: Sequence[SecretPattern] = tuple(rules.DEFAULT_PATTERNS)
) -> Callable[[DataFrame, int], None]:
    """Writer for a stream of ``read_lines``: the findings in the new files of each micro-batch, files of any size.

    A file lands in one micro-batch whole, so its lines are numbered there.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        scan_lines(batch, patterns).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def alert_events(alerts: DataFrame) -> DataFrame:
    """Alerts in the shape of webhook events; the data holds the whole alert."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp")
    rest = [c for c in alerts.columns if c not in ("alert_id", "ts", "resolved", "acknowledged")]
    fields = [F.col("alert_id").alias("id"), stamp, F.lit(False).alias("resolved"), F.lit(False).alias("acknowledged"), *rest]
    return alerts.select(
        F.lit("scan").alias("event"),
        F.lit("monitoring").alias("package"),
        F.lit("1.0.0").alias("version"),
        "ts",
        F.to_json(F.struct(F.struct(*fields).alias("alert"))).alias("data"),
    )


def notify_batch(urls: Sequence[str], outbox: str) -> Callable[[DataFrame, int], None]:
    """Writer that puts one outbox row per alert and webhook.

    Every micro-batch goes to its own folder and replaces it, so a batch that
    is run again after a failure leaves no duplicates.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = webhook_outbox(alert_events(batch), urls)
        rows.write.mode("overwrite").parquet(f"{outbox}/batch={batch_id}")

    return write


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Writer that keeps the rows of each micro-batch in a folder of their own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_available(
    stream: DataFrame, sink: str | Callable[[DataFrame, int], None], checkpoint: str,
    mode: str = "append",
) -> StreamingQuery:
    """Process what is there and stop; ``sink`` is a parquet folder or a batch writer."""
    return _start(stream, sink, checkpoint, mode, {"availableNow": True})


def run_every(
    stream: DataFrame, sink: str | Callable[[DataFrame, int], None], checkpoint: str,
    mode: str = "append", interval: str = rules.METRIC_INTERVAL,
) -> StreamingQuery:
    """Run for good, one micro-batch per interval."""
    return _start(stream, sink, checkpoint, mode, {"processingTime": interval})


def _start(stream, sink, checkpoint, mode, trigger) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(**trigger)
    if callable(sink):
        return writer.foreachBatch(sink).start()
    return writer.format("parquet").option("path", sink).start()
