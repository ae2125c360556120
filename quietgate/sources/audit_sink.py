"""Append-only audit table, partitioned by day and batch.

A batch is what one write adds.  Writing a batch again replaces it, so a retried write adds no row.  Rows are rebalanced
by day first: Spark splits and merges to files of the session's advisory size, however many tasks made the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def append(log: DataFrame, path: str, batch: str | None = None) -> None:
    """Add the rows as one batch; with the name of a batch written before, replace that one's rows of the same days."""
    dated = log.withColumn("day", F.to_date("ts")).withColumn("batch", F.lit(batch or uuid.uuid4().hex))
    (dated.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day", "batch").parquet(path))


def stream_append(log: DataFrame, path: str, checkpoint: str, records: Callable[[DataFrame], DataFrame] = lambda rows: rows, **trigger):
    """Append a stream of audit records, one batch per micro-batch; a micro-batch run again replaces itself.

    ``records`` makes the audit records of a micro-batch where the stream holds something else.  ``path`` belongs to one
    checkpoint: the batches of another one would have the same names.
    """
    def write(rows: DataFrame, number: int) -> None:
        append(records(rows), path, f"stream-{number}")

    return (log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def read(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Audit records, optionally only the retained days (whole day directories are skipped)."""
    log = spark.read.parquet(path).drop("batch")
    return log.where(F.col("day") >= F.lit(since).cast("date")) if since else log
