"""Audit records of decisions, and the statistics read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quietgate import fixed_values as v


def records(decisions: DataFrame, ts: str, correlation_id: str, user_id: str, action: str, text: str, violations: str,
            scan_time_ms: str) -> DataFrame:
    """One audit row per decision."""
    found = F.coalesce(F.size(violations), F.lit(0))
    return decisions.select(
        F.col(ts).alias("ts"), F.col(correlation_id).cast("string").alias("correlation_id"),
        F.col(user_id).cast("string").alias("user_id"), F.col(action).alias("action"),
        F.substring(text, 1, v.AUDIT_PREVIEW).alias("text_preview"),
        F.greatest(found, F.lit(0)).alias("violation_count"), F.col(violations).alias("violations"),
        F.col(scan_time_ms).cast("double").alias("scan_time_ms"))


def stats(log: DataFrame) -> DataFrame:
    is_ = lambda a: F.count_if(F.col("action") == a)
    return log.agg(F.count("*").alias("total"), is_("block").alias("blocks"), is_("warn").alias("warnings"),
                   is_("allow").alias("allows"))


def tail(log: DataFrame, limit: int = v.AUDIT_TAIL, order: tuple[str, ...] = ("ts", "correlation_id")) -> DataFrame:
    """Newest entries, oldest of them first; each task keeps only its own newest ones."""
    newest = log.orderBy(*(F.col(c).desc() for c in order)).limit(limit)
    return newest.orderBy(*order)


def metrics(log: DataFrame, last: int = v.METRIC_ROWS, order: tuple[str, ...] = ("ts", "correlation_id")) -> DataFrame:
    """Request totals and the mean scan time of the newest requests."""
    counts = ("total_requests", "total_blocked", "total_warnings")
    totals = log.agg(F.count("*").alias(counts[0]), F.count_if(F.col("action") == "block").alias(counts[1]),
                     F.count_if(F.col("action") == "warn").alias(counts[2]))
    newest = log.select(*order, "scan_time_ms").orderBy(*(F.col(c).desc() for c in order)).limit(last)
    mean = newest.agg(F.round(F.coalesce(F.avg("scan_time_ms"), F.lit(0.0)), 2).alias("average_scan_time_ms"))
    # Two one-row results, put side by side.
    return totals.unionByName(mean, allowMissingColumns=True).agg(
        *(F.max(c).alias(c) for c in (*counts, "average_scan_time_ms")))
