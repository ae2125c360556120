"""Checks of a model output against its prompt, its context and an expected format."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from quietgate import fixed_values as v
from quietgate.functions.text import fenced, let, rx, sentences, strings, with_forms, words
from quietgate.operators import toxicity
from quietgate.operators.grounding import contains_of, share_contained

ISSUES_TYPE = "array<struct<issue_type:string,description:string,severity:string,score:double>>"


def _issue(kind: str, description: Column | str, severity: Column | str, score: Column | None = None) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    value = score if score is not None else F.lit(None)
    return F.struct(F.lit(kind).alias("issue_type"), as_col(description).alias("description"),
                    as_col(severity).alias("severity"), value.cast("double").alias("score"))


def _none() -> Column:
    return F.array().cast(ISSUES_TYPE)


def key_words(lowered: Column, least: int, stop_words: list[str]) -> Column:
    """Distinct words of at least ``least`` characters without the stop words."""
    long_enough = F.filter(words(lowered), lambda w: F.char_length(w) >= least)
    return F.array_except(long_enough, strings(stop_words))


def relevance_of(prompt: Column, output: Column) -> Column:
    """Share of the prompt's key words that the output repeats, null when the prompt has none."""
    asked = key_words(F.lower(prompt), 3, v.RELEVANCE_STOP_WORDS)
    said = key_words(F.lower(output), 3, v.RELEVANCE_STOP_WORDS)
    return let(asked, lambda a: F.when(
        F.size(a) > 0, F.size(F.array_intersect(a, said)).cast("double") / F.size(a).cast("double")))


def relevance_issues(relevance: Column, threshold: float = v.RELEVANCE_THRESHOLD) -> Column:
    return F.when(relevance < F.lit(float(threshold)), F.array(_issue(
        "irrelevant", "Output may not be relevant to the prompt", "medium", relevance))).otherwise(_none())


def safety_issues(threshold: float = v.TOXICITY_THRESHOLD, tag: str = "__x") -> Column:
    """One issue per flagged category; needs the toxicity score columns."""
    issues = []
    for category in toxicity.CATEGORIES:
        score = F.col(f"{tag}_{category}")
        severity = (F.when(score >= F.lit(v.BAND_TOP), F.lit("critical"))
                    .when(score >= F.lit(v.BAND_MIDDLE), F.lit("high")).otherwise(F.lit("medium")))
        issues.append(F.when(score >= F.lit(float(threshold)), _issue(
            "unsafe", f"Output contains potentially harmful content: {category}", severity, score)))
    return F.when(toxicity.overall_of(tag) >= F.lit(float(threshold)),
                  F.array_compact(F.array(*issues)).cast(ISSUES_TYPE)).otherwise(_none())


def _grounding_sentences(output: Column) -> Column:
    return F.filter(sentences(output), lambda s: F.char_length(s) >= v.GROUNDING_MIN_CHARS)


def _grounding_words(sentence: Column) -> Column:
    return key_words(F.lower(sentence), 4, v.GROUNDING_STOP_WORDS)


def items_of(output: Column) -> Column:
    """The strings ``grounding_of`` looks for in the context."""
    return F.array_distinct(F.flatten(F.transform(_grounding_sentences(output), _grounding_words)))


def grounding_of(output: Column, context: Column, threshold: float = v.GROUNDING_THRESHOLD, known: Column | None = None) -> Column:
    """(sentences counted, ungrounded sentences, ungrounded share).

    ``known`` is null, or lists the strings that a context kept elsewhere contains (``plans.evidence``).
    """

    def shares(context_lower: Column) -> Column:
        contains = contains_of(context_lower, known)
        return F.transform(_grounding_sentences(output), lambda s: let(
            _grounding_words(s), lambda w: F.when(F.size(w) > 0, share_contained(w, contains))))

    def summary(found: Column) -> Column:
        bad = F.size(F.filter(found, lambda s: s < F.lit(float(threshold))))
        return F.struct(
            F.size(found).alias("sentences"), bad.alias("ungrounded"),
            F.when(F.size(found) > 0, bad.cast("double") / F.size(found).cast("double")).otherwise(F.lit(0.0)).alias("share"))

    return let(let(F.lower(context), shares), summary)


def grounding_issues(grounding: Column) -> Column:
    return F.when(grounding["share"] > F.lit(v.UNGROUNDED_SHARE), F.array(_issue(
        "ungrounded", "Output contains claims not grounded in the provided context", "high", grounding["share"],
    ))).otherwise(_none())


def is_json(text: Column) -> Column:
    """Exactly one JSON value and nothing after it."""
    return F.try_parse_json(text).isNotNull() & (F.coalesce(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))), F.lit(0)) == 1)


def format_issues(output: Column, expected: Mapping) -> Column:
    """Issues of an expected-format description (max_length, min_length, type, required_fields, pattern, must_not_contain)."""
    size = F.char_length(output)
    found: list[Column] = []
    most, least = expected.get("max_length"), expected.get("min_length")
    if most:
        found.append(F.when(size > most, _issue("format_violation", F.concat(
            F.lit("Output exceeds max length ("), size.cast("string"), F.lit(f" > {most})")), "low")))
    if least:
        found.append(F.when(size < least, _issue("format_violation", F.concat(
            F.lit("Output below min length ("), size.cast("string"), F.lit(f" < {least})")), "low")))
    if expected.get("type") == "json":
        valid = is_json(output)
        found.append(F.when(~valid, _issue("format_violation", "Output is not valid JSON", "medium")))
        if expected.get("required_fields"):
            keys = F.when(valid, F.json_object_keys(output))
            missing = F.filter(strings(expected["required_fields"]), lambda f: ~F.array_contains(keys, f))
            found.append(F.when(keys.isNotNull() & (F.size(missing) > 0), _issue("format_violation", F.concat(
                F.lit("Missing required fields: "), F.array_join(missing, ", ")), "medium")))
    if expected.get("pattern"):
        wanted = expected["pattern"]
        found.append(F.when(~output.rlike(rx(wanted, ignore_case=False)), _issue(
            "format_violation", f"Output does not match expected pattern: {wanted}", "low")))
    for word in expected.get("must_not_contain") or ():
        found.append(F.when(F.lower(output).contains(word.lower()), _issue(
            "format_violation", f"Output contains forbidden content: '{word}'", "medium")))
    return F.array_compact(F.array(*found)).cast(ISSUES_TYPE) if found else _none()


def validate(df: DataFrame, prompt: str = "prompt", output: str = "output", context: str | None = "context",
             expected: Mapping | None = None, relevance_threshold: float = v.RELEVANCE_THRESHOLD,
             grounding_threshold: float = v.GROUNDING_THRESHOLD, toxicity_threshold: float = v.TOXICITY_THRESHOLD,
             out: str = "validation", known: str | None = None) -> DataFrame:
    """All checks as one struct: valid or not, issues in order; ``known`` as in ``grounding_of``."""
    staged, forms, extra = with_forms(df, output, toxicity.literals())
    scored, names = toxicity.add_scores(staged, forms)
    parts: dict[str, Column] = {"__rel": relevance_of(F.col(prompt), F.col(output))}
    if context:
        has_context, listed = F.char_length(context) > 0, None if known is None else F.col(known)
        if known:
            has_context = has_context | listed.isNotNull()
        parts["__gro"] = F.when(has_context, grounding_of(F.col(output), F.col(context), grounding_threshold, listed))
    measured = scored.select("*", *(c.alias(n) for n, c in parts.items()))
    issues = [relevance_issues(F.col("__rel"), relevance_threshold), safety_issues(toxicity_threshold)]
    if context:
        issues.append(grounding_issues(F.col("__gro")))
    if expected:
        issues.append(format_issues(F.col(output), expected))
    held = measured.withColumn("__issues", F.concat(*issues))
    bad = F.exists("__issues", lambda i: i["severity"].isin("high", "critical"))
    return fenced(held, out, F.when(F.col(output).isNotNull(), F.struct(
        (~bad).alias("is_valid"), F.col("__issues").alias("issues"), F.col("__rel").alias("relevance"),
    ))).drop("__issues", *parts, *extra, *names)
