"""Stream queries run to the end of the available files and read back from their sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.plants import planted
from quietgate.sources import audit_sink
from quietgate.streaming import behavior_stream, micro_batches, rate_limit_stream, scan_stream

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def work_folder(spark: SparkSession) -> str:
    """A new folder in the shared folder the cluster names; on one machine beside the warehouse where none is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_streams"
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table as a stream of a few files per micro-batch, so that a batch is bounded."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet").parquet(f"{path}*")


def drained(stream: DataFrame) -> DataFrame:
    """Write everything available to Parquet and read it; the session's state store setting is put back."""
    spark = stream.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, STATE_STORE)
    try:
        folder = work_folder(spark)
        query = (stream.writeStream.format("parquet").option("path", f"{folder}/out")
                 .option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "user_id", F.col("user_id").cast("string"))


def _behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    return _events(spark, sf_dir).select(
        "user_id", "event_id", "ts", F.concat_ws(" ", "event_type", "props").alias("text"),
        (kind == "error").alias("was_injection"), (kind == "signup").alias("was_toxic"),
        ((kind == "error") & (value > 100)).alias("was_blocked"), F.least(value / 300, F.lit(1.0)).alias("confidence"))


def abuse(spark: SparkSession, sf_dir: str, limits) -> DataFrame:
    return drained(behavior_stream.detect(_behavior(spark, sf_dir), limits))


def abuse_batches(spark: SparkSession, sf_dir: str, limits) -> DataFrame:
    """Through the batch operators: judged rows, and late ones, of which the table has none."""
    folder = work_folder(spark)
    behavior_stream.start(_behavior(spark, sf_dir), f"{folder}/out", f"{folder}/state", limits).awaitTermination()
    return micro_batches.judged(spark, f"{folder}/out")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    return _events(spark, sf_dir).select(
        "user_id", "event_id", "ts",
        F.when((kind == "error") & (value > 150), "block").when(kind == "error", "warning")
        .when((kind == "signup") & (value > 120), "reset").otherwise("check").alias("kind"))


def rate_limits(spark: SparkSession, sf_dir: str, settings) -> DataFrame:
    return drained(rate_limit_stream.check(_calls(spark, sf_dir), settings))


def rate_limit_batches(spark: SparkSession, sf_dir: str, settings) -> DataFrame:
    folder = work_folder(spark)
    rate_limit_stream.start(_calls(spark, sf_dir), f"{folder}/out", f"{folder}/state", settings).awaitTermination()
    return micro_batches.judged(spark, f"{folder}/out")


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("user_id"), F.timestamp_seconds("doc_id").alias("ts"),
        planted(F.col("text"), F.col("doc_id")).alias("text"))
    folder = work_folder(spark)
    scan_stream.start(docs, f"{folder}/log", f"{folder}/state").awaitTermination()
    return audit_sink.read(spark, f"{folder}/log")
