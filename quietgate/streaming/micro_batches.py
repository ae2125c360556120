"""Micro-batches judged by the batch operators, with late rows set apart and a table of what later batches need.

The keyed streams of this package hold a user's rows of one micro-batch in one task.  Here a micro-batch goes through the
batch operators instead, which cut busy users into ranges, together with the state that earlier micro-batches left.
Every input row ends up in one of two folders: ``judged``, or ``late`` if it is not after its user's last row, or older
than the newest row by more than the delay, when its user may be forgotten.  A micro-batch that runs again replaces what
it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SECOND = 1_000_000
Judge = Callable[[DataFrame, DataFrame | None, int], tuple[DataFrame, DataFrame]]


def is_late(delay_seconds: float, horizon: int) -> Column:
    """Rows with ``at, event_id`` and their user's ``__clock``, the place of the last row taken in."""
    behind = F.struct("at", "event_id") <= F.col("__clock")
    return F.coalesce(behind, F.lit(False)) | (F.col("at") < F.lit(horizon - int(delay_seconds * SECOND)))


def _split(rows: DataFrame, before: DataFrame | None, delay_seconds: float) -> tuple[DataFrame, DataFrame]:
    """Rows in time and late rows."""
    if before is None:
        return rows, rows.where("false")
    horizon = before.agg(F.max("clock.at")).first()[0] or 0
    clocks = before.groupBy(F.col("user_id").alias("__user")).agg(F.max("clock").alias("__clock"))
    marked = rows.join(clocks, rows["user_id"].eqNullSafe(clocks["__user"]), "left").withColumn(
        "__late", is_late(delay_seconds, horizon))
    return marked.where("not __late").select(*rows.columns), marked.where("__late").select(*rows.columns)


def start(events: DataFrame, judge: Judge, path: str, checkpoint: str, delay_seconds: float, **trigger):
    """Judge a stream of rows with ``user_id, event_id, at``.

    ``judge(rows, state, newest)`` gets the rows in time, the state that the micro-batch before left, or None, and the
    time of the newest row so far; it returns the results and the next state, which has ``user_id`` and ``clock``, a
    struct of the last ``at, event_id`` of the user.  Two state tables take turns.
    """
    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        before = spark.read.parquet(f"{path}/state/{(number - 1) % 2}") if number else None
        fresh, late = _split(rows, before, delay_seconds)
        newest = max((r[0] or 0 for r in (rows.agg(F.max("at")).first(), *([before.agg(F.max("clock.at")).first()] if number else []))), default=0)
        judged, state = judge(fresh, before, newest)
        late.write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        judged.write.mode("overwrite").parquet(f"{path}/judged/batch={number}")
        state.write.mode("overwrite").parquet(f"{path}/state/{number % 2}")
        rows.unpersist()

    return (events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def judged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/judged").drop("batch")


def late(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/late").drop("batch")
