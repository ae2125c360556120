"""The scan as a stream: the same narrow projection, appended to the audit table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quietgate.operators import audit
from quietgate.plans import scan
from quietgate.session import spread
from quietgate.sources import audit_sink


def audit_records(texts: DataFrame, level: str = "moderate") -> DataFrame:
    """Audit rows of a batch or stream with ``id, user_id, ts, text``."""
    scanned = scan.scan(texts, "text", level).select(
        "id", "user_id", "ts", "text", F.col("scan.action").alias("action"), F.col("scan.violations").alias("violations"),
        F.lit(None).cast("double").alias("scan_time_ms"))
    return audit.records(scanned, "ts", "id", "user_id", "action", "text", "violations", "scan_time_ms")


def start(texts: DataFrame, path: str, checkpoint: str, level: str = "moderate", **trigger):
    """Scan a stream into the audit table; a micro-batch of few files is spread over all cores before it is scanned."""
    return audit_sink.stream_append(texts, path, checkpoint, lambda batch: audit_records(spread(batch), level), **trigger)
