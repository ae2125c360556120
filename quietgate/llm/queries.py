"""One query per operator, each over its whole table with the parameters meant for production."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quietgate.llm import (
    decontamination, grammar_store, language_id, language_model, length_histogram, ngram_join, packing, personal_data,
    quality_classifier, quality_rules, spelling_variants, substring_dedup, token_alignment,
)
from quietgate.llm.common import held_out, shared_folder
from quietgate.llm.tokens import vocabulary


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns or ("doc_id", "text"))


def op1_benchmark_decontamination(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.matches(_documents(spark, sf_dir), items)


def op2_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.ngram_components(_documents(spark, sf_dir), size=3, numerator=90)


def op2_ngram_jaccard_links(spark, sf_dir):
    return ngram_join.ngram_links(_documents(spark, sf_dir), size=3, numerator=90)[1]


def op3_language_model(spark, sf_dir):
    return language_model.scored(_documents(spark, sf_dir), held_out=held_out(F.col("doc_id"), 10, 0), order=3)


def op4_quality_rules(spark, sf_dir):
    judged = quality_rules.judged(_documents(spark, sf_dir, "doc_id", "text", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_token_id_output(spark, sf_dir):
    folder = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    grammar_store.write(_documents(spark, sf_dir), folder, vocabulary("word_bpe_49k.json"))
    return grammar_store.read(spark, folder, checksums=True)


def op6_personal_data(spark, sf_dir):
    return personal_data.detect(_documents(spark, sf_dir))


def op7_packing(spark, sf_dir):
    pieces = packing.pack(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), checksums=True)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op8_language_id(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    aside = held_out(F.col("doc_id"), 5, 0)
    network = language_id.fit(docs, seen=~aside)
    return language_id.predict(docs, network, held_out=aside)


def op9_quality_classifier(spark, sf_dir):
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    aside = held_out(F.col("doc_id"), 4, 2)
    model = quality_classifier.fit(docs, labels, usable=~aside)
    scored = quality_classifier.score(docs, model, held_out=aside)
    return scored.withColumn("predicted", (F.col("score") >= quality_classifier.THRESHOLD).cast("int"))


def op10_token_counts(spark, sf_dir):
    return length_histogram.histogram(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op11_token_alignment(spark, sf_dir):
    found = token_alignment.aligned(
        _documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return token_alignment.digest(found)


def op12_substring_dedup(spark, sf_dir):
    return substring_dedup.digest(substring_dedup.deduplicated(_documents(spark, sf_dir)))


def op13_spelling_variants(spark, sf_dir):
    return spelling_variants.variants(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_benchmark_decontamination, op2_ngram_jaccard_join, op2_ngram_jaccard_links, op3_language_model, op4_quality_rules, op5_token_id_output,
    op6_personal_data, op7_packing, op8_language_id, op9_quality_classifier, op10_token_counts, op11_token_alignment,
    op12_substring_dedup, op13_spelling_variants,
)}
