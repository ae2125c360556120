"""Profanity spans and the content filter that combines toxicity, policy and profanity."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quietgate import fixed_values as v
from quietgate.functions.text import any_of, fenced, replace_from_right, rx, with_forms, with_spans, worst_of
from quietgate.operators import policy as policy_rules, toxicity

FILTER_SEVERITIES = ("info", "warning", "critical")
VIOLATION_TYPE = (
    "array<struct<category:string,matched_text:string,severity:string,action:string,start:int,end:int>>"
)


def _word(word: str) -> str:
    return rx(rf"\b{re.escape(word)}\b")


def _violation(category: Column, matched: Column, severity: Column, action: Column, start: Column, end: Column) -> Column:
    return F.struct(category.alias("category"), matched.alias("matched_text"), severity.alias("severity"),
                    action.alias("action"), start.alias("start"), end.alias("end"))


def add_profanity(df: DataFrame, lower: Column, words: Sequence[str] | None, out: str) -> DataFrame:
    """Whole-word hits in list order, offsets in the lower-cased text."""
    # Lower-cased text may still hold a dotless i or a long s, which match i and s.
    folds = lower.rlike("[ſı]")
    found = with_spans(df, lower, [(_word(w), lower.contains(w.lower()) | folds) for w in words or v.PROFANITY], "__words")
    return found.withColumn(out, F.transform("__words", lambda s: _violation(
        F.lit("profanity"), s["text"], F.lit("warning"), F.lit("redact"), s["start"], s["end"]))).drop("__words")


def profanity(df: DataFrame, text: str = "text", words: Sequence[str] | None = None, out: str = "profanity") -> DataFrame:
    lowered = df.withColumn("__l", F.lower(text))
    found = add_profanity(lowered, F.col("__l"), words, "__p")
    return fenced(found, out, F.col("__p")).drop("__l", "__p")


def mask_profanity(df: DataFrame, text: str = "text", words: Sequence[str] | None = None,
                   replacement: str = v.PROFANITY_REPLACEMENT, out: str = "filtered") -> DataFrame:
    """Replace listed words one after the other, exactly as listed."""
    staged, forms, extra = with_forms(df, text)
    literal = re.sub(r"([\\$])", r"\\\1", replacement)
    masked = forms.text
    for word in words or v.PROFANITY:
        masked = F.regexp_replace(masked, _word(word), literal)
    guard = any_of(forms.lower.contains(w.lower()) for w in words or v.PROFANITY)
    return staged.withColumn(out, F.when(forms.odd | guard, masked).otherwise(forms.text)).drop(*extra)


def filter_content(df: DataFrame, text: str = "text", policy: policy_rules.Policy | None = None,
                   threshold: float = v.TOXICITY_THRESHOLD, words: Sequence[str] | None = None,
                   replacement: str = v.PROFANITY_REPLACEMENT, out: str = "filter") -> DataFrame:
    """Violations from toxicity, an optional policy and profanity; block, redact, log or none."""
    staged, forms, extra = with_forms(df, text, toxicity.literals())
    scored, names = toxicity.add_scores(add_profanity(staged, forms.lower, words, "__profane"), forms)
    none, zero = F.array().cast(VIOLATION_TYPE), F.lit(0)
    flagged = []
    for category in toxicity.CATEGORIES:
        score = F.col(f"__x_{category}")
        severity = (F.when(score >= F.lit(v.BAND_TOP), F.lit("critical"))
                    .when(score >= F.lit(v.BAND_MIDDLE), F.lit("warning")).otherwise(F.lit("info")))
        label = F.concat(F.lit(f"[toxicity:{category}="), F.format_string("%.2f", score), F.lit("]"))
        flagged.append(F.when(score >= F.lit(float(threshold)), _violation(
            F.lit(category), label, severity, F.lit("flagged"), zero, zero)))
    toxic = F.when(toxicity.overall_of() >= F.lit(float(threshold)),
                   F.array_compact(F.array(*flagged)).cast(VIOLATION_TYPE)).otherwise(none)
    ruled = none
    if policy is not None:
        ruled = F.transform(policy_rules.violations_of(forms, [policy]), lambda x: _violation(
            F.concat(F.lit("policy:"), x["rule"]), x["matched_text"],
            F.when(x["severity"] == "critical", F.lit("critical"))
            .when(x["severity"].isin("high", "medium"), F.lit("warning")).otherwise(F.lit("info")),
            x["action"], zero, zero))
    held = scored.withColumn("__all", F.concat(toxic, ruled, F.col("__profane")))
    found = F.col("__all")
    worst = worst_of(found["severity"], FILTER_SEVERITIES, "none")
    action = (F.when(worst == "critical", F.lit("block")).when(worst == "warning", F.lit("redact"))
              .when(worst == "info", F.lit("log")).otherwise(F.lit("none")))
    placed = F.transform(
        F.array_sort(F.transform(
            F.filter(found, lambda x: x["end"] > x["start"]),
            lambda x, i: F.struct((-x["start"]).alias("back"), i.alias("i"), x.alias("v")))),
        lambda s: s["v"])
    decided = held.withColumn("__action", action)
    filtered = F.when(F.col("__action") == "redact",
                      replace_from_right(F.col(text), placed, lambda _: F.lit(replacement))).otherwise(F.col(text))
    return fenced(decided, out, F.when(F.col(text).isNotNull(), F.struct(
        filtered.alias("filtered_text"), found.alias("violations"), F.col("__action").alias("action"),
        (F.size(found) == 0).alias("is_clean"),
    ))).drop("__all", "__action", "__profane", *extra, *names)
