"""Delivery of webhook payloads: what was tried, what came through, what is due again.

The log of attempts is the only state. It is appended to in rounds, each in a folder of its own that a repeated
round replaces, so that a round that failed half way and runs again counts once. Every (event, URL) is a delivery of
its own: a URL that fails holds up nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELIVERY = ["event_id", "url"]
# Tries before a delivery counts as failed, seconds before the second try; each later wait is twice as long.
MOST_TRIES = 5
FIRST_WAIT_SECONDS = 60


def _settled(outbox: DataFrame, attempts: DataFrame, most_tries: int, first_wait: int, kept: Sequence[str] = ()) -> DataFrame:
    """Per delivery the columns of ``delivery_state``, and the columns ``kept`` of one of its rows, named ``kept <column>``."""
    # Rows of both tables are dealt out by delivery together and folded there: one shuffle, no join and no sorting. The number of
    # parts is given, as Spark would join parts of few bytes, in which such rows are too many for the tables they are folded in.
    parts = int(outbox.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = outbox.select(
        *DELIVERY, F.lit(True).alias("wanted"), F.col("ts").alias("wanted_at"), F.monotonically_increasing_id().alias("row"),
        *[F.col(f"`{c}`").alias(f"kept {c}") for c in kept],
    )
    # A delivery without id or URL is never tried.
    logged = attempts.dropna(subset=DELIVERY).select(*DELIVERY, "attempt", F.col("ts").alias("tried_at"), "ok")
    dealt = wanted.unionByName(logged, allowMissingColumns=True).repartition(parts, *DELIVERY)
    once = dealt.groupBy(*DELIVERY, "attempt").agg(
        F.bool_or("wanted").alias("wanted"), F.min("wanted_at").alias("wanted_at"), F.min("row").alias("row"),
        F.min("tried_at").alias("tried_at"), F.bool_or("ok").alias("ok"), *_of_first_row(kept),
    )
    # The orders are numbers of fixed width, which are folded in a hash table; structs of them would be sorted.
    good, bad = (F.when(ok, F.col("attempt")) for ok in (F.col("ok"), ~F.col("ok")))
    folded = once.groupBy(*DELIVERY).agg(
        F.bool_or("wanted").alias("wanted"), F.min("wanted_at").alias("wanted_at"), F.min(good).alias("success"),
        F.min_by("tried_at", good).alias("delivered_at"), F.max_by("tried_at", bad).alias("failed_at"), F.max("attempt").alias("last"),
        *_of_first_row(kept),
    ).where("wanted")
    tries = F.coalesce(F.col("success"), F.col("last"), F.lit(0)).cast("long")
    status = (
        F.when(F.col("success").isNotNull(), "delivered")
        .when(F.col("last").isNull(), "new")
        .when(tries >= most_tries, "failed")
        .otherwise("waiting")
    )
    wait = F.make_dt_interval(secs=(first_wait * F.pow(F.lit(2.0), F.col("tries") - 1)).cast("decimal(18,6)"))
    due = F.when(F.col("status") == "new", F.col("wanted_at")).when(F.col("status") == "waiting", F.col("failed_at") + wait)
    return folded.withColumns({"tries": tries, "status": status}).select(
        *[F.col(c).cast(outbox.schema[c].dataType).alias(c) for c in DELIVERY], "tries", "status", "delivered_at",
        due.alias("next_try_at"), *[f"kept {c}" for c in kept],
    )


def _of_first_row(kept: Sequence[str]) -> list[Column]:
    return [F.min_by(f"kept {c}", "row").alias(f"kept {c}") for c in kept]


def delivery_state(
    outbox: DataFrame, attempts: DataFrame, most_tries: int = MOST_TRIES, first_wait: int = FIRST_WAIT_SECONDS
) -> DataFrame:
    """Per delivery its tries, status and next try.

    ``outbox(event_id, url, ts, ...)``, ``attempts(event_id, url, attempt, ts, ok)``; an attempt that is logged twice counts once,
    and those after the first success do not count. status is ``new``, ``waiting``, ``delivered`` or ``failed``; ``next_try_at``
    is null unless the delivery is new, and then its own time, or waiting. Repeated outbox rows are one delivery.
    """
    return _settled(outbox, attempts, most_tries, first_wait)


def due_deliveries(state: DataFrame, now: Column) -> DataFrame:
    """Deliveries to try now, with the number of the next attempt."""
    return state.where(F.col("next_try_at") <= now).select(*DELIVERY, (F.col("tries") + 1).alias("attempt"))


def read_attempts(spark: SparkSession, path: str, key: str = "bigint") -> DataFrame:
    """The log of attempts; before the first round it is empty."""
    schema = f"event_id {key}, url string, attempt bigint, ts timestamp_ntz, ok boolean, round string"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def deliver_round(
    outbox: DataFrame, path: str, round_id: str, now: Column, send: Callable[[DataFrame], DataFrame],
    most_tries: int = MOST_TRIES, first_wait: int = FIRST_WAIT_SECONDS,
) -> None:
    """Send all due payloads once and log the outcome under the round's id.

    ``send`` gets the due rows with the columns of the outbox and adds a boolean ``ok``; it should not raise for a URL that
    fails. A round that is run again decides on the log without itself and replaces what it wrote.
    """
    spark = outbox.sparkSession
    key = outbox.schema["event_id"].dataType.simpleString()
    log = read_attempts(spark, path, key).where(F.col("round") != round_id).drop("round")
    others = [c for c in outbox.columns if c not in DELIVERY]
    due = _settled(outbox, log, most_tries, first_wait, others).dropna(subset=DELIVERY).where(F.col("next_try_at") <= now)
    rows = due.select(*DELIVERY, *[F.col(f"`kept {c}`").alias(c) for c in others], (F.col("tries") + 1).alias("attempt"))
    sent = send(rows).select(*DELIVERY, "attempt", now.cast("timestamp_ntz").alias("ts"), F.coalesce("ok", F.lit(False)).alias("ok"))
    sent.write.mode("overwrite").parquet(f"{path}/round={round_id}")


def delivery_rate(state: DataFrame) -> DataFrame:
    """Per URL the deliveries in each status, the share that came through of those that ended, and tries per delivery."""
    ended = F.col("status").isin("delivered", "failed")
    return state.groupBy("url").agg(
        F.count("*").alias("deliveries"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("delivered", "failed", "waiting", "new")],
        F.avg(F.when(ended, (F.col("status") == "delivered").cast("int"))).alias("success_rate"),
        F.sum("tries").alias("tries"),
    )
