"""Toxicity scores per category from keywords and patterns, and the parsing of an external classifier."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quietgate import fixed_values as v
from quietgate.functions.text import Forms, fenced, kept, literals_of, with_forms

CATEGORIES = tuple(category for category, *_ in v.TOXICITY)


def literals() -> list[str]:
    return literals_of([p for *_, patterns in v.TOXICITY for p in patterns], [w for _, _, words, _ in v.TOXICITY for w in words])


def category_score(forms: Forms, weight: float, keywords: Sequence[str], patterns: Sequence[str]) -> Column:
    """Hits added left to right in catalogue order: the order decides the last bit of a double."""
    hits = [(forms.has(word.lower()), v.KEYWORD_SCORE) for word in keywords]
    hits += [(forms.matches(pattern), v.REGEX_SCORE) for pattern in patterns]
    total = reduce(lambda acc, h: acc + F.when(h[0], F.lit(h[1])).otherwise(F.lit(0.0)), hits, F.lit(0.0))
    return F.least(F.lit(1.0), total * F.lit(weight))


def add_scores(df: DataFrame, forms: Forms, tag: str = "__x") -> tuple[DataFrame, list[str]]:
    names = [f"{tag}_{category}" for category in CATEGORIES]
    scores = [category_score(forms, *rest).alias(name) for name, (_, *rest) in zip(names, v.TOXICITY)]
    return df.select("*", *scores), names


def overall_of(tag: str = "__x") -> Column:
    return F.greatest(*(F.col(f"{tag}_{c}") for c in CATEGORIES))


def flagged_of(threshold: float, category_thresholds: Mapping[str, float] | None = None, tag: str = "__x") -> Column:
    limits = category_thresholds or {}
    return kept((F.col(f"{tag}_{c}") >= F.lit(float(limits.get(c, threshold))), c) for c in CATEGORIES)


def result_struct(text: Column, threshold: float, category_thresholds: Mapping[str, float] | None = None,
                  tag: str = "__x") -> Column:
    scores = F.create_map(*(x for c in CATEGORIES for x in (F.lit(c), F.col(f"{tag}_{c}"))))
    return F.when(text.isNotNull(), F.struct(
        scores.alias("scores"), overall_of(tag).alias("overall_score"),
        (overall_of(tag) >= F.lit(float(threshold))).alias("is_toxic"),
        flagged_of(threshold, category_thresholds, tag).alias("flagged_categories"),
    ))


def classify(df: DataFrame, text: str = "text", threshold: float = v.TOXICITY_THRESHOLD,
             category_thresholds: Mapping[str, float] | None = None, out: str = "toxicity") -> DataFrame:
    """Scores, overall score, verdict and flagged categories as one struct column."""
    staged, forms, extra = with_forms(df, text, literals())
    scored, names = add_scores(staged, forms)
    return fenced(scored, out, result_struct(F.col(text), threshold, category_thresholds)).drop(*extra, *names)


REPLY_SCHEMA = "scores map<string,double>, overall double, flagged array<string>"


def prefer_reply(df: DataFrame, reply: str, toxicity: str = "toxicity", threshold: float = v.TOXICITY_THRESHOLD,
                 out: str = "judged") -> DataFrame:
    """Use an external classifier's JSON reply where it parses, the rule result elsewhere."""
    staged = df.withColumn("__reply", F.from_json(reply, REPLY_SCHEMA))
    said, base = F.col("__reply"), F.col(toxicity)
    parsed = F.try_parse_json(F.col(reply)).isNotNull() & F.json_object_keys(reply).isNotNull()
    scores = F.coalesce(said["scores"], F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    overall = F.coalesce(said["overall"], F.array_max(F.map_values(scores)), F.lit(0.0))
    ours = F.struct(
        scores.alias("scores"), overall.alias("overall_score"), (overall >= F.lit(threshold)).alias("is_toxic"),
        F.coalesce(said["flagged"], F.array().cast("array<string>")).alias("flagged_categories"))
    return staged.withColumn(out, F.when(parsed, ours).otherwise(base)).drop("__reply")
