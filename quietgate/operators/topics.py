"""Topic boundaries from keyword overlap, with embeddings as a second opinion."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quietgate import fixed_values as v
from quietgate.functions.text import fenced, let, strings, words

STEM = 4


def key_words(topic: str) -> list[str]:
    """Meaningful words of a topic name, order and repeats kept; topics are parameters."""
    return [w for w in re.findall(r"\w+", topic.lower()) if w not in v.TOPIC_STOP_WORDS and len(w) > 2]


def _hits(text_words: Column, keyword: str) -> Column:
    """Some word of the text equals the keyword or shares its stem, either way round."""
    def alike(word: Column) -> Column:
        stem = F.when(F.char_length(word) > STEM, F.substring(word, 1, STEM)).otherwise(word)
        return word.startswith(keyword[:STEM] if len(keyword) > STEM else keyword) | F.lit(keyword).startswith(stem)
    return F.exists(text_words, alike)


def overlap_of(text_words: Column, topic: str) -> tuple[Column, Column]:
    """Matched keywords and their share of the topic's keywords."""
    listed = key_words(topic)
    matched = F.array_compact(F.array(*(F.when(_hits(text_words, k), F.lit(k)) for k in listed))) if listed else strings(())
    return matched, F.size(matched).cast("double") / F.lit(float(max(len(listed), 1)))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def semantic_of(vector: Column, topics: Sequence[tuple[str, Sequence[float]]]) -> Column:
    """Closest topic by dot product, the first of equals."""
    scored = F.array(*(F.struct(
        dot(vector, F.array(*(F.lit(float(x)) for x in values))).alias("score"), F.lit(-i).alias("back"),
        F.lit(name).alias("topic")) for i, (name, values) in enumerate(topics)))
    return let(F.array_max(scored), lambda top: F.struct(
        (top["score"] >= F.lit(v.TOPIC_SEMANTIC)).alias("is_on_topic"),
        F.when(top["score"] >= F.lit(v.TOPIC_HIT), top["topic"]).alias("detected_topic"),
        top["score"].alias("similarity_score"),
        top["topic"].alias("closest_allowed_topic"),
        strings(()).alias("matched_keywords")))


def semantic(df: DataFrame, vector: str, topics: Sequence[tuple[str, Sequence[float]]], out: str = "topic") -> DataFrame:
    return df.withColumn(out, semantic_of(F.col(vector), topics))


def check(df: DataFrame, text: str = "text", allowed: Sequence[str] = (), blocked: Sequence[str] = (),
          mode: str = "permissive", vector: str | None = None,
          topic_vectors: Sequence[tuple[str, Sequence[float]]] = (), out: str = "topic") -> DataFrame:
    """On topic or not: the first blocked topic wins, then the best allowed one."""
    staged = df.withColumn("__words", F.array_distinct(words(F.lower(text))))
    names: dict[str, Column] = {}
    for kind, listed in (("b", blocked), ("a", allowed)):
        for i, topic in enumerate(listed):
            names[f"__{kind}{i}"] = overlap_of(F.col("__words"), topic)[0]
    matched = staged.select("*", *(c.alias(n) for n, c in names.items())).drop("__words")

    def share(name: str, topic: str) -> Column:
        return F.size(name).cast("double") / F.lit(float(max(len(key_words(topic)), 1)))

    def verdict(on: Column, detected: Column, score: Column, closest: Column, keywords: Column) -> Column:
        return F.struct(on.alias("is_on_topic"), detected.cast("string").alias("detected_topic"),
                        score.alias("similarity_score"), closest.cast("string").alias("closest_allowed_topic"),
                        keywords.alias("matched_keywords"))

    null = F.lit(None).cast("string")
    if allowed:
        best = F.array_max(F.array(*(F.struct(
            share(f"__a{i}", t).alias("score"), F.lit(-i).alias("back"), F.lit(t).alias("topic"),
            F.col(f"__a{i}").alias("keywords")) for i, t in enumerate(allowed))))

        def of_best(top: Column) -> Column:
            some = top["score"] > 0
            topic = F.when(some, top["topic"])
            needed = v.TOPIC_HIT if mode == "strict" else v.TOPIC_PERMISSIVE
            by_words = verdict(top["score"] >= F.lit(needed), topic, top["score"], topic,
                               F.when(some, top["keywords"]).otherwise(strings(())))
            if vector is None or not topic_vectors:
                return by_words
            return let(semantic_of(F.col(vector), topic_vectors), lambda s: F.when(
                F.col(vector).isNotNull() & (top["score"] < F.lit(v.TOPIC_HIT)) & (s["similarity_score"] > top["score"]), s,
            ).otherwise(by_words))

        result = let(best, of_best)
    else:
        result = verdict(F.lit(True), null, F.lit(1.0), null, strings(()))
    for i, topic in reversed(list(enumerate(blocked))):
        result = F.when(share(f"__b{i}", topic) >= F.lit(v.TOPIC_HIT), verdict(
            F.lit(False), F.lit(topic), share(f"__b{i}", topic), null, F.col(f"__b{i}"))).otherwise(result)
    return fenced(matched, out, F.when(F.col(text).isNotNull(), result)).drop(*names)
