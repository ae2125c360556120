"""Prompt injection: named patterns, structural markers, encoded content, merged with an external judge."""

from __future__ import annotations

import logging
import re
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quietgate import fixed_values as v
from quietgate.functions.text import Forms, exploded, fenced, forms_of, kept, let, literals_of, rx, strings, with_forms
from quietgate.operators.encoding import decoded_items

Rule = tuple[str, str, str]  # name, category, pattern
log = logging.getLogger(__name__)


def threshold_of(sensitivity: str) -> float:
    return v.SENSITIVITY_THRESHOLDS.get(sensitivity, v.DEFAULT_SENSITIVITY_THRESHOLD)


def usable_rules(spark: SparkSession, custom: Sequence[dict] | None) -> tuple[list[Rule], list[str]]:
    """Custom rules that both pattern dialects accept, and the names of those skipped."""
    good, skipped = [], []
    for rule in custom or ():
        if _compiles(spark, rule["pattern"]):
            good.append((rule["name"], rule.get("category", "custom"), rule["pattern"]))
        else:
            skipped.append(rule["name"])
            log.warning("custom rule %s has no valid pattern and is skipped", rule["name"])
    return good, skipped


def _compiles(spark: SparkSession, pattern: str) -> bool:
    """Compiled where it stands, in both dialects; no job is run, and no other failure is taken for a bad pattern."""
    try:
        re.compile(pattern)
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(rx(pattern))
    except re.error:
        return False
    except Py4JJavaError as failure:
        if "PatternSyntaxException" not in failure.java_exception.getClass().getName():
            raise
        return False
    return True


def literals(rules: Sequence[Rule] = v.INJECTION_PATTERNS, markers: bool = True) -> list[str]:
    return literals_of([p for *_, p in rules] + (list(v.STRUCTURAL_MARKERS) if markers else []))


def pattern_names(forms: Forms, rules: Sequence[Rule] = v.INJECTION_PATTERNS, multiline: bool = True) -> Column:
    return kept((forms.matches(pattern, multiline=multiline), name) for name, _, pattern in rules)


def marker_names(forms: Forms) -> Column:
    return kept((forms.matches(m, multiline=True), f"structural:{m}") for m in v.STRUCTURAL_MARKERS)


def stepped_confidence(hits: Column, base: float, step: float) -> Column:
    """``min(1, base + step * hits)``, zero without a hit."""
    grown = F.least(F.lit(1.0), F.lit(base) + hits.cast("double") * F.lit(step))
    return F.when(hits > 0, grown).otherwise(F.lit(0.0))


def encoded_names(decoded: Column, rules: Sequence[Rule] = v.INJECTION_PATTERNS) -> Column:
    """Pattern names per decoded item, in item order, repeats kept."""

    def names(item: Column) -> Column:
        return let(item["decoded"], lambda d: pattern_names(
            forms_of(d), [(f"encoded:{n}", c, p) for n, c, p in rules], multiline=False))

    return F.when(F.size(decoded) > 0, F.flatten(F.transform(decoded, names))).otherwise(strings(()))


def layer(confidence: Column, flag: Column, method: str, names: Column) -> Column:
    return F.struct(confidence.alias("confidence"), flag.alias("flag"), F.lit(method).alias("method"),
                    names.alias("names"))


def merged(layers: Sequence[Column]) -> dict[str, Column]:
    """Any flag, highest confidence, first layer that reaches it, names in layer order."""
    best, method = layers[0]["confidence"], F.when(layers[0]["confidence"] > 0, layers[0]["method"])
    flag, names = layers[0]["flag"], [layers[0]["names"]]
    for one in layers[1:]:
        method = F.when(one["confidence"] > best, one["method"]).otherwise(method)
        best = F.greatest(best, one["confidence"])
        flag = flag | one["flag"]
        names.append(one["names"])
    return {"is_injection": flag, "confidence": best, "method": method, "matched_patterns": F.concat(*names)}


def add_layers(df: DataFrame, forms: Forms, rules: Sequence[Rule], tag: str = "__i") -> tuple[DataFrame, list[str]]:
    """Raw material of all layers as hidden columns, each computed once."""
    names = [f"{tag}_patterns", f"{tag}_markers", f"{tag}_decoded"]
    first = df.select(
        "*",
        pattern_names(forms, rules).alias(names[0]),
        marker_names(forms).alias(names[1]),
        decoded_items(forms).alias(names[2]),
    )
    return first.withColumn(f"{tag}_encoded", encoded_names(F.col(names[2]), rules)), [*names, f"{tag}_encoded"]


def layer_columns(threshold: float, tag: str = "__i") -> list[Column]:
    patterns, markers = F.col(f"{tag}_patterns"), F.col(f"{tag}_markers")
    decoded, encoded = F.col(f"{tag}_decoded"), F.col(f"{tag}_encoded")
    c1 = stepped_confidence(F.size(patterns), v.PATTERN_BASE, v.PATTERN_STEP)
    c2 = stepped_confidence(F.size(markers), v.STRUCTURAL_BASE, v.STRUCTURAL_STEP)
    c3 = (F.when(F.size(encoded) > 0, F.lit(v.ENCODED_HIT))
          .when(F.size(decoded) > 0, F.lit(v.ENCODED_ONLY)).otherwise(F.lit(0.0)))
    flag = lambda c, hits: (F.size(hits) > 0) & (c >= F.lit(threshold))
    return [
        layer(c1, flag(c1, patterns), "pattern_match", patterns),
        layer(c2, flag(c2, markers), "structural_analysis", markers),
        layer(c3, flag(c3, encoded), "encoding_detection", encoded),
    ]


def result_struct(text: Column, threshold: float, tag: str = "__i") -> Column:
    parts = merged(layer_columns(threshold, tag))
    decoded, markers = F.col(f"{tag}_decoded"), F.col(f"{tag}_markers")
    return F.when(text.isNotNull(), F.struct(
        *(c.alias(n) for n, c in parts.items()),
        F.when(F.size(decoded) > 0, F.size(decoded)).alias("decoded_items"),
        F.when(F.size(markers) > 0, F.size(markers)).alias("markers_count"),
    ))


def detect(df: DataFrame, text: str = "text", sensitivity: str = "medium",
           custom_patterns: Sequence[dict] | None = None, out: str = "injection") -> DataFrame:
    """All layers merged into one struct column."""
    rules = [*v.INJECTION_PATTERNS, *usable_rules(df.sparkSession, custom_patterns)[0]]
    staged, forms, extra = with_forms(df, text, literals(rules))
    layered, more = add_layers(staged, forms, rules)
    return fenced(layered, out, result_struct(F.col(text), threshold_of(sensitivity))).drop(*extra, *more)


def detect_patterns(df: DataFrame, text: str = "text", rules: Sequence[Rule] = v.INJECTION_PATTERNS,
                    sensitivity: str = "medium", out: str = "injection") -> DataFrame:
    """The pattern layer alone."""
    staged, forms, extra = with_forms(df, text, literals(rules, markers=False))
    named = staged.withColumn("__names", pattern_names(forms, rules))
    confidence = stepped_confidence(F.size("__names"), v.PATTERN_BASE, v.PATTERN_STEP)
    return fenced(named, out, F.when(F.col(text).isNotNull(), F.struct(
        ((F.size("__names") > 0) & (confidence >= threshold_of(sensitivity))).alias("is_injection"),
        confidence.alias("confidence"), F.col("__names").alias("matched_patterns"),
    ))).drop("__names", *extra)


def detect_structural(df: DataFrame, text: str = "text", sensitivity: str = "medium",
                      out: str = "structural") -> DataFrame:
    """The structural layer alone."""
    staged, forms, extra = with_forms(df, text, literals(()))
    named = staged.withColumn("__names", marker_names(forms))
    confidence = stepped_confidence(F.size("__names"), v.STRUCTURAL_BASE, v.STRUCTURAL_STEP)
    return fenced(named, out, F.when(F.col(text).isNotNull(), F.struct(
        ((F.size("__names") > 0) & (confidence >= threshold_of(sensitivity))).alias("is_injection"),
        confidence.alias("confidence"), F.col("__names").alias("matched_patterns"),
    ))).drop("__names", *extra)


def detect_encoded(df: DataFrame, text: str = "text", sensitivity: str = "medium", out: str = "encoded") -> DataFrame:
    """The encoding layer alone."""
    staged, forms, extra = with_forms(df, text)
    held = staged.withColumn("__d", decoded_items(forms)).withColumn("__n", encoded_names(F.col("__d")))
    confidence = (F.when(F.size("__n") > 0, F.lit(v.ENCODED_HIT))
                  .when(F.size("__d") > 0, F.lit(v.ENCODED_ONLY)).otherwise(F.lit(0.0)))
    return fenced(held, out, F.when(F.col(text).isNotNull(), F.struct(
        ((F.size("__n") > 0) & (confidence >= threshold_of(sensitivity))).alias("is_injection"),
        confidence.alias("confidence"), F.col("__n").alias("matched_patterns"), F.size("__d").alias("decoded_items"),
    ))).drop("__d", "__n", *extra)


def sensitivity_sweep(df: DataFrame, text: str = "text", levels: Sequence[str] = ("low", "medium", "high")) -> DataFrame:
    """One flag per sensitivity level from a single pass over the text."""
    staged, forms, extra = with_forms(df, text, literals())
    layered, more = add_layers(staged, forms, v.INJECTION_PATTERNS)
    flags = [merged(layer_columns(threshold_of(level)))["is_injection"].alias(f"injection_{level}") for level in levels]
    return layered.select("*", *flags).drop(*extra, *more)


def category_counts(df: DataFrame, text: str = "text", rules: Sequence[Rule] = v.INJECTION_PATTERNS) -> DataFrame:
    """Texts and pattern hits per rule category."""
    staged, forms, _ = with_forms(df, text, literals(rules, markers=False))
    by_category = {}
    for name, category, pattern in rules:
        by_category.setdefault(category, []).append((name, category, pattern))
    per_row = F.array(*(F.struct(F.lit(c).alias("category"), F.size(pattern_names(forms, r)).alias("hits"))
                        for c, r in by_category.items()))
    hits = exploded(staged, (), F.filter(per_row, lambda x: x["hits"] > 0), "pos", "x").select("x.*")
    return hits.groupBy("category").agg(F.count("*").alias("texts"), F.sum("hits").alias("hits"))


JUDGE_SCHEMA = "is_injection boolean, confidence double, reason string"


def merge_judge(df: DataFrame, reply: str, injection: str = "injection", out: str = "judged") -> DataFrame:
    """Fold an external judge's JSON reply column into a detection result; a bad reply changes nothing."""
    said, base = F.from_json(reply, JUDGE_SCHEMA), F.col(injection)
    staged = df.withColumn("__reply", said)
    confidence = F.coalesce(F.col("__reply.confidence"), F.lit(0.0))
    flag = F.coalesce(F.col("__reply.is_injection"), F.lit(False))
    return staged.withColumn(out, F.struct(
        (base["is_injection"] | flag).alias("is_injection"),
        F.greatest(base["confidence"], confidence).alias("confidence"),
        F.when(confidence > base["confidence"], F.lit("llm_classification")).otherwise(base["method"]).alias("method"),
        base["matched_patterns"].alias("matched_patterns"),
        F.col("__reply.reason").alias("reason"),
    )).drop("__reply")
