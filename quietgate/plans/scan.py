"""Whole scans: detectors and policy combined into one decision per text, in one narrow stage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quietgate import fixed_values as v
from quietgate.functions.text import any_of, distinct_literals, exploded, fenced, with_forms
from quietgate.operators import injection, policy as policy_rules, toxicity, validation

VIOLATIONS_TYPE = policy_rules.VIOLATIONS_TYPE


def _decision(found: Column, ranked: Sequence[str]) -> Column:
    """First of the ranked actions that some violation asks for, else allow."""
    out = F.lit("allow")
    for action in reversed(ranked):
        out = F.when(F.exists(found, lambda x: x["action"] == action), F.lit(action)).otherwise(out)
    return out


def _block(rule: str, matched: Column) -> Column:
    return F.array(F.struct(F.lit(rule).alias("rule"), matched.alias("matched_text"), F.lit("high").alias("severity"),
                            F.lit("block").alias("action")))


def _scanned(df: DataFrame, text: str, policies: Sequence[policy_rules.Policy], ranked: Sequence[str],
             sensitivity: str, threshold: float) -> tuple[DataFrame, list[str]]:
    shared = [*injection.literals(), *toxicity.literals(), *policy_rules.literals(policies)]
    staged, forms, extra = with_forms(df, text, distinct_literals(shared))
    layered, more = injection.add_layers(staged, forms, v.INJECTION_PATTERNS)
    scored, names = toxicity.add_scores(layered, forms)
    results = scored.select(
        "*",
        injection.result_struct(F.col(text), injection.threshold_of(sensitivity)).alias("__inj"),
        toxicity.result_struct(F.col(text), threshold).alias("__tox"),
        policy_rules.violations_of(forms, policies).alias("__pol"),
    ).drop(*extra, *more, *names)
    inj, tox, none = F.col("__inj"), F.col("__tox"), F.array().cast(VIOLATIONS_TYPE)
    listed = F.array_join(F.slice(inj["matched_patterns"], 1, 3), ", ")
    violations = F.concat(
        F.when(inj["is_injection"], _block("prompt_injection", F.nullif(listed, F.lit("")))).otherwise(none),
        F.when(tox["is_toxic"], _block("toxicity", F.array_join(tox["flagged_categories"], ", "))).otherwise(none),
        F.col("__pol"))
    decided = results.withColumn("__found", violations).withColumn("__action", _decision(F.col("__found"), ranked))
    return decided, ["__inj", "__tox", "__pol", "__found", "__action"]


def _answer(text: str, *more: Column) -> Column:
    safe = F.col("__action") == "allow"
    return F.when(F.col(text).isNotNull(), F.struct(
        safe.alias("is_safe"), F.col("__action").alias("action"), F.col("__found").alias("violations"),
        F.when(safe, F.col(text)).alias("processed_text"), *more))


def scan(df: DataFrame, text: str = "text", level: str = "moderate", policies: Sequence[policy_rules.Policy] | None = None,
         sensitivity: str = "medium", threshold: float = v.TOXICITY_THRESHOLD, out: str = "scan") -> DataFrame:
    """Injection, toxicity and policy; allow, warn, redact or block."""
    rules = policy_rules.preset(level) if policies is None else policies
    decided, hidden = _scanned(df, text, rules, ("block", "redact", "warn"), sensitivity, threshold)
    return fenced(decided, out, _answer(
        text, F.col("__inj.confidence").alias("injection_score"), F.col("__tox.overall_score").alias("toxicity_score"),
        F.col("__inj.method").alias("injection_method"), F.col("__tox.flagged_categories").alias("flagged_categories"),
    )).drop(*hidden)


def guard_input(df: DataFrame, text: str = "text", level: str = "moderate", out: str = "guard") -> DataFrame:
    """As ``scan``, but a redact action does not make an input unsafe."""
    decided, hidden = _scanned(df, text, policy_rules.preset(level), ("block", "warn"), "medium", v.TOXICITY_THRESHOLD)
    return fenced(decided, out, _answer(text)).drop(*hidden)


def guard_output(df: DataFrame, prompt: str = "prompt", output: str = "output", context: str | None = "context",
                 expected: Mapping | None = None, out: str = "guard", known: str | None = None) -> DataFrame:
    """Output checks turned into allow, warn or block; only a block makes the output unsafe."""
    checked = validation.validate(df, prompt, output, context, expected, out="__val", known=known)
    violations = F.transform(F.col("__val.issues"), lambda i: F.struct(
        i["issue_type"].alias("rule"), i["description"].alias("matched_text"), i["severity"].alias("severity"),
        F.when(i["severity"].isin("high", "critical"), F.lit("block")).otherwise(F.lit("warn")).alias("action")))
    decided = checked.withColumn("__found", violations).withColumn(
        "__action", _decision(F.col("__found"), ("block", "warn")))
    safe = F.col("__action") != "block"
    return fenced(decided, out, F.when(F.col(output).isNotNull(), F.struct(
        safe.alias("is_safe"), F.col("__action").alias("action"), F.col("__found").alias("violations"),
        F.when(safe, F.col(output)).alias("processed_text"), F.size("__found").alias("validation_issues"),
    ))).drop("__val", "__found", "__action")


def guard_requests(log: DataFrame, path: str = "path", method: str = "method", body: str = "body",
                   prefixes: Sequence[str] = v.PROTECTED_PREFIXES, out: str = "guard") -> DataFrame:
    """Score and action of every logged request; unprotected paths and other methods pass with score one."""
    scanned = any_of(F.col(path).startswith(p) for p in prefixes) & F.col(method).isin(*v.SCANNED_METHODS) & (
        F.char_length(body) > 0)
    # Texts that are not scanned become null and cost nothing.
    chosen = log.withColumn("__text", F.when(scanned, F.col(body)))
    decided, hidden = _scanned(chosen, "__text", [], ("block",), "medium", v.TOXICITY_THRESHOLD)
    injected = F.coalesce(F.col("__inj.is_injection"), F.lit(False))
    toxic = F.coalesce(F.col("__tox.is_toxic"), F.lit(False))
    score = F.when(injected, F.lit(1.0) - F.col("__inj.confidence")).otherwise(F.lit(1.0))
    score = F.when(toxic, F.least(score, F.lit(1.0) - F.col("__tox.overall_score"))).otherwise(score)
    return fenced(decided, out, F.struct(
        score.alias("score"), F.when(injected | toxic, F.lit("block")).otherwise(F.lit("allow")).alias("action"),
        scanned.alias("scanned"))).drop("__text", *hidden)


def _exact_mean(column: str) -> Column:
    """Mean of scores, taken from an exact sum of nine decimals, so that no order of the rows changes it."""
    return F.sum(F.col(column).cast("decimal(18,9)")).cast("double") / F.count(column)


def corpus_report(scanned: DataFrame, by: Sequence[str], result: str = "scan") -> DataFrame:
    """Texts and mean scores per group and action; the same for any partitioning."""
    return scanned.groupBy(*by, F.col(f"{result}.action").alias("action")).agg(
        F.count("*").alias("texts"),
        _exact_mean(f"{result}.injection_score").alias("mean_injection"),
        _exact_mean(f"{result}.toxicity_score").alias("mean_toxicity"))


def rule_report(scanned: DataFrame, by: Sequence[str] = (), result: str = "scan") -> DataFrame:
    """Texts per violated rule."""
    hits = exploded(scanned, by, f"{result}.violations", "pos", "v")
    return hits.groupBy(*by, F.col("v.rule").alias("rule"), F.col("v.action").alias("action")).agg(
        F.count("*").alias("violations"))
