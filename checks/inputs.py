"""Inputs of the queries, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.plants import planted
from quietgate.operators import validation
from quietgate.plans.evidence import with_earlier
from quietgate.plans.pairing import pair_turns
from quietgate.session import spread


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return read.select(*columns) if columns else read


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as they are: doc_id, source, lang, text."""
    return spread(table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each with a planted line."""
    return documents(spark, sf_dir).withColumn("text", planted(F.col("text"), F.col("doc_id")))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and output of every answered user turn; the outputs carry planted lines."""
    paired = pair_turns(turns(spark, sf_dir))
    return paired.withColumn("output", planted(F.col("output"), F.col("conv_id") * 7 + F.col("turn")))


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with all earlier turns: in the row, or as the output's words that occur in them."""
    return with_earlier(answers(spark, sf_dir), turns(spark, sf_dir), validation.items_of(F.col("output")))[0]


def behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log read as safety results per user."""
    kind, value = F.col("event_type"), F.col("value")
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", "ts", F.concat_ws(" ", "event_type", "props").alias("text"),
        (kind == "error").alias("was_injection"), (kind == "signup").alias("was_toxic"),
        ((kind == "error") & (value > 100)).alias("was_blocked"), F.least(value / 300, F.lit(1.0)).alias("confidence"))


def limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log read as rate limiter calls."""
    kind, value = F.col("event_type"), F.col("value")
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", "ts",
        F.when((kind == "error") & (value > 150), "block").when(kind == "error", "warning")
        .when((kind == "signup") & (value > 120), "reset").otherwise("check").alias("kind"))


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log read as an audit log."""
    action = (F.when(F.col("event_type") == "error", "block").when(F.col("event_type") == "signup", "warn")
              .when(F.col("event_type") == "view", "redact").otherwise("allow"))
    return table(spark, sf_dir, "events").select(
        "ts", F.col("event_id").alias("correlation_id"), "user_id", action.alias("action"), F.col("value").alias("scan_time_ms"),
        F.col("props").alias("text"))
