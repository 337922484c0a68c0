"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings every job relies on; all are plain Spark options.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Rows can be long lines or whole files; an Arrow batch holds about this many bytes of them.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    # Streaming state on local disk, so that it may outgrow executor memory.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("release-guard")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.cache
def _local_folder(application: str) -> str:
    folder = tempfile.mkdtemp(prefix=f"release-guard-{application}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


@functools.cache
def _shipped(application: str) -> str:
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="release-guard-")) / "release_guard"
    return shutil.make_archive(str(archive), "zip", package.parent, package.name)


def ship_package(spark: SparkSession) -> None:
    """Let Spark hand this package to the Python workers, once per application.

    Jobs with Python functions need it wherever the package is not installed on the executors.
    """
    archive = _shipped(spark.sparkContext.applicationId)
    if not any(path.endswith(archive) for path in spark.sparkContext.listFiles):
        spark.sparkContext.addPyFile(archive)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint folder of the session.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a session
    that runs on one machine may fall back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        base = _local_folder(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def small_table(spark: SparkSession, columns: dict[str, pa.DataType], rows: list[tuple]) -> DataFrame:
    """A configuration table as a local relation, whose exact size Spark knows."""
    schema = pa.schema(list(columns.items()))
    arrays = [pa.array([row[i] for row in rows], type=t) for i, t in enumerate(columns.values())]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=schema))


# Spark's own clean-up of a job's shuffle files once the job has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back.

    For a table that several jobs read: it is computed once, and what follows
    does not depend on the executors that made it. Its shuffle files go when it is written.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.parquet(path)


# Up to how many bytes of text a written table is sent to all executors.
SMALL_BYTES = 32 << 20


def is_small(df: DataFrame, size: Column) -> bool:
    """Whether the ``size`` of the rows of a written table, in bytes, sums up to little."""
    return (df.agg(F.sum(size + 32)).first()[0] or 0) <= SMALL_BYTES


def small_side(df: DataFrame, size: Column) -> DataFrame:
    """Mark a written table for broadcast if it is small by ``is_small``; a larger one is joined by shuffle."""
    return F.broadcast(df) if is_small(df, size) else df
