"""Text and event inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

MAX_CHARS = 50_000


def read_texts(spark: SparkSession, path: str, key: str, text: str, *keep: str) -> DataFrame:
    """Key and text of a Parquet table, nothing else is read."""
    return spark.read.parquet(path).select(F.col(key).alias("id"), F.col(text).alias("text"), *keep)


def split_valid(df: DataFrame, text: str = "text", max_chars: int = MAX_CHARS) -> tuple[DataFrame, DataFrame]:
    """Texts an interactive request would accept, and the rest with the reason."""
    reason = (F.when(F.col(text).isNull(), "missing").when(F.char_length(text) == 0, "empty")
              .when(F.char_length(text) > max_chars, "too long"))
    marked = df.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


EVENT_SCHEMA = (
    "event_id bigint, user_id string, ts timestamp, text string, was_injection boolean, was_toxic boolean, "
    "was_blocked boolean, confidence double"
)
LIMITER_SCHEMA = "event_id bigint, user_id string, ts timestamp, kind string"


def read_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def stream_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, files_per_trigger: int | None = None) -> DataFrame:
    """Event files as a stream; ``files_per_trigger`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)
