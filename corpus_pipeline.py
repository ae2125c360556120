"""From documents to packed training sequences, one operator of ``quietgate.llm`` per stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quietgate.llm import decontamination, language_id, packing, personal_data
from quietgate.llm.common import cut, held_out, shared_folder, small
from quietgate.llm.ngram_join import ngram_components
from quietgate.llm.tokens import vocabulary

LEAST_SCORE = 0.5     # of the language named; below it no language has the majority of a text
DROPPED_ROWS = 2_000_000  # keys of dropped documents that may be sent to every executor


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key of their id and text: decisions are about texts, whatever ids repeat or are missing."""
    return docs.withColumn("__key", F.xxhash64("doc_id", "text"))


def _without(keyed: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows whose key is not in ``dropped`` (one column, ``__gone``)."""
    keys = cut(dropped.distinct())
    side = F.broadcast(keys) if small(keys, DROPPED_ROWS) else keys
    return keyed.join(side, keyed["__key"] == side["__gone"], "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the network knows stay; texts without letters and undecided ones go.

    Every row is judged by its own text: null and empty texts go, rows that repeat an id or have none stay or go as
    their texts say, repeated rows alike.  An empty table stays empty.
    """
    network = language_id.fit(docs, seen=~held_out(F.col("doc_id"), 5, 0))
    keyed = _keyed(docs)
    found = language_id.predict(keyed, network, key="__key")
    rejected = (F.col("lang_pred") == language_id.UNKNOWN) | (F.col("score") < LEAST_SCORE)
    return _without(keyed, found.where(rejected).select(F.col("__key").alias("__gone"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; rows without an id stay.

    Of rows that repeat an id and its text, one stays; different texts under one id are documents of their own.  Null
    texts and texts without words are nobody's copies.  An empty table stays empty.
    """
    keyed = docs.withColumn("__key", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    alike = cut(ngram_components(keyed, key="__key", size=5, numerator=80).where("__key is not null").select(
        "__key", "component_id").distinct())
    several = alike.where("__key <> component_id").select("component_id").distinct()
    members = alike.join(several, "component_id", "left_semi").join(
        keyed.select("doc_id", "__key").where("__key is not null").distinct(), "__key")
    first = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "__key")).alias("first"))
    gone = members.join(first, "component_id").where(F.col("__key") != F.col("first.__key"))
    kept = _without(keyed, gone.select(F.col("__key").alias("__gone")))
    twice = cut(kept.where("__key is not null").groupBy("__key").count().where("count > 1").select(F.col("__key").alias("__twice")))
    side = F.broadcast(twice) if small(twice, DROPPED_ROWS) else twice
    repeats = kept["__key"] == side["__twice"]
    once = kept.join(side, repeats, "left_semi").dropDuplicates(["__key"])
    return kept.join(side, repeats, "left_anti").unionByName(once).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, row by row, whatever ids repeat or are missing.

    Null and empty texts hold none and stay; repeated rows go or stay alike.  An empty table stays empty.
    """
    keyed = _keyed(docs)
    hit = decontamination.matches(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="__key")
    return _without(keyed, hit.select(F.col("__key").alias("__gone"))).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind; ``n_chars`` is counted anew.

    Null texts stay null, repeated rows are changed alike, and no row goes.  An empty table stays empty.
    """
    changed = personal_data.redact(docs)
    return changed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else changed


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024, 512, 256 and 128 tokens, with the checksum of their ids.

    Null and empty texts are the end id alone; repeated rows are packed each; an empty table gives no pieces.
    """
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), checksums=True)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("redact", redact),
    ("pack", pack),
]

ORACLE_SQL = None  # trained models and token packing have no SQL form; the stages are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; each stage's rows are written to the shared folder and read by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        path = f"{folder}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
