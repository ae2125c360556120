"""Session settings the jobs rely on; on a cluster the launcher's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rule sets become large expression trees: recording a call site per node costs more than building it.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Regex work is CPU bound: small input splits give every core something to do.
    "spark.sql.files.maxPartitionBytes": "32m",
}


def local_session(cores: int | str = 8, name: str = "quietgate", **extra: str) -> SparkSession:
    """A local session for tests and measurements."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.ui.enabled", "false").config(
        "spark.ui.showConsoleProgress", "false")
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", **extra}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def spread(df):
    """Give CPU-bound text work one task per core when the input comes in fewer splits.

    A table of many files already has more splits than cores and is left alone, so at scale
    no shuffle is added; a single small file would otherwise be scanned by one task.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted * 2) if df.rdd.getNumPartitions() < wanted else df
