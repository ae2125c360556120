"""Policy rules: a small rule set compiled into Column expressions, evaluated in one projection."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quietgate import fixed_values as v
from quietgate.functions.text import Forms, any_of, fenced, literals_of, number_text, rx, with_forms, worst_of

RULES_SCHEMA = (
    "policy_ord int, policy string, description string, action string, severity string, enabled boolean, "
    "rule_ord int, rule_type string, rule_description string, pattern string, keywords array<string>, threshold double"
)
VIOLATIONS_TYPE = "array<struct<rule:string,matched_text:string,severity:string,action:string>>"


def _over_batches(judge: Callable[[pd.Series, pd.Series], pd.Series]):
    """A Python function applied to Arrow batches; it sees texts only, null texts are not violated."""
    def run(texts: pd.Series, scores: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), dtype=object)
        known = texts.notna()
        if known.any():
            found = judge(texts[known], scores[known].fillna(0.0))
            out[known] = found.astype(object).where(found.notna(), None).to_numpy()
        return out

    return F.pandas_udf(run, "string")


@dataclass(frozen=True)
class Rule:
    rule_type: str
    description: str
    pattern: str | None = None
    keywords: tuple[str, ...] | None = None
    threshold: float | None = None
    # custom rules: function(text column, score column or None) -> matched text, null when not violated
    evaluate: Callable[[Column, Column | None], Column] | None = field(default=None, compare=False)
    # or a function over batches: (texts, scores) as pandas series -> matched texts, null when not violated
    batch: Callable[[pd.Series, pd.Series], pd.Series] | None = field(default=None, compare=False)

    def matched(self, forms: Forms, score: Column | None) -> Column:
        """Matched text as a column, null where the rule is not violated."""
        if self.rule_type == "regex" and self.pattern:
            found = F.regexp_extract(forms.text, rx(self.pattern), 0)
            return F.when(forms.matches(self.pattern), found)
        if self.rule_type == "keyword" and self.keywords:
            tests = (F.when(forms.has(word.lower()), F.lit(word)) for word in self.keywords)
            return F.coalesce(*tests)
        if self.rule_type == "threshold" and self.threshold is not None:
            value = F.coalesce(score, F.lit(0.0)) if score is not None else F.lit(0.0)
            return F.when(value >= F.lit(float(self.threshold)), F.concat(F.lit("score="), number_text(value)))
        if self.rule_type == "custom" and self.evaluate is not None:
            return self.evaluate(forms.text, score)
        if self.rule_type == "custom" and self.batch is not None:
            return _over_batches(self.batch)(forms.text, F.lit(0.0) if score is None else score.cast("double"))
        return F.lit(None).cast("string")


@dataclass(frozen=True)
class Policy:
    name: str
    rules: tuple[Rule, ...]
    action: str = "block"
    severity: str = "high"
    description: str = ""
    enabled: bool = True

    def __post_init__(self) -> None:
        _known(self.action, v.ACTIONS, "action")
        _known(self.severity, v.SEVERITIES, "severity")
        for rule in self.rules:
            _known(rule.rule_type, v.RULE_TYPES, "rule type")


def _known(value: str, allowed: Sequence[str], what: str) -> None:
    if value not in allowed:
        raise ValueError(f"unknown {what} {value!r}, expected one of {', '.join(allowed)}")


def _rule(spec: tuple) -> Rule:
    kind, description, value = spec
    slot = {"regex": "pattern", "keyword": "keywords", "threshold": "threshold"}[kind]
    return Rule(kind, description, **{slot: value})


def _policy(spec: tuple) -> Policy:
    name, description, action, severity, rules = spec
    return Policy(name, tuple(map(_rule, rules)), action, severity, description)


def preset(level: str) -> list[Policy]:
    """Preset policies of a level; an unknown level means the default one."""
    return [_policy(spec) for spec in v.PRESETS.get(level, v.PRESETS[v.DEFAULT_LEVEL])]


def custom_template() -> list[Policy]:
    return [_policy(v.CUSTOM_TEMPLATE)]


def with_policy(policies: Iterable[Policy], added: Policy) -> list[Policy]:
    return [*policies, added]


def without_policy(policies: Iterable[Policy], name: str) -> list[Policy]:
    return [p for p in policies if p.name != name]


def switched(policies: Iterable[Policy], name: str, enabled: bool) -> list[Policy]:
    return [replace(p, enabled=enabled) if p.name == name else p for p in policies]


def rules_table(spark: SparkSession, policies: Sequence[Policy]) -> DataFrame:
    """The rule set as a table, one row per rule in evaluation order; a policy without rules has one row of null rule fields."""
    def rule_rows(p: Policy) -> list[tuple]:
        return [(j, r.rule_type, r.description, r.pattern, list(r.keywords) if r.keywords else None, r.threshold)
                for j, r in enumerate(p.rules)] or [(None,) * 6]

    rows = [(i, p.name, p.description, p.action, p.severity, p.enabled, *rule)
            for i, p in enumerate(policies) for rule in rule_rows(p)]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def policies_of(rules: DataFrame, most_rules: int = 10_000) -> list[Policy]:
    """Read a rule table back to compile it; it is configuration, and its size is checked before it is fetched."""
    rows = rules.orderBy("policy_ord", "rule_ord").limit(most_rules + 1).collect()
    if len(rows) > most_rules:
        raise ValueError(f"a rule set of more than {most_rules} rules cannot be compiled into one plan")
    grouped: dict[tuple, list[Rule]] = {}
    for r in rows:
        key = (r.policy_ord, r.policy, r.action, r.severity, r.description, r.enabled)
        grouped.setdefault(key, [])
        if r.rule_type is not None:
            grouped[key].append(Rule(r.rule_type, r.rule_description, r.pattern,
                                     tuple(r.keywords) if r.keywords else None, r.threshold))
    return [Policy(name, tuple(found), action, severity, description, enabled)
            for (_, name, action, severity, description, enabled), found in grouped.items()]


def literals(policies: Iterable[Policy]) -> list[str]:
    rules = [r for p in policies if p.enabled for r in p.rules]
    return literals_of([r.pattern for r in rules if r.rule_type == "regex" and r.pattern],
                       [w for r in rules for w in r.keywords or ()])


def violations_of(forms: Forms, policies: Sequence[Policy], score: Column | None = None) -> Column:
    """All violations of all enabled policies, in order."""
    found = []
    for policy in policies:
        for rule in policy.rules if policy.enabled else ():
            found.append(F.struct(
                F.lit(rule.description).alias("rule"), rule.matched(forms, score).alias("matched_text"),
                F.lit(policy.severity).alias("severity"), F.lit(policy.action).alias("action")))
    if not found:
        return F.array().cast(VIOLATIONS_TYPE)
    return F.filter(F.array(*found), lambda x: x["matched_text"].isNotNull()).cast(VIOLATIONS_TYPE)


def names_hit(df: DataFrame, policies: Sequence[Policy], text: str = "text", score: str | None = None, out: str = "hit") -> DataFrame:
    """Names of the enabled policies that a text violates; a rule that several policies share is tested once."""
    key = lambda r: (r.rule_type, r.pattern, r.keywords, r.threshold, r.evaluate, r.batch)
    enabled = [p for p in policies if p.enabled]
    rules = {key(r): r for p in enabled for r in p.rules}
    column = {k: f"__rule{i}" for i, k in enumerate(rules)}
    staged, forms, extra = with_forms(df, text, literals(enabled))
    tested = staged.select("*", *(r.matched(forms, F.col(score) if score else None).isNotNull().alias(column[k]) for k, r in rules.items()))
    hit = [F.when(any_of(F.col(column[key(r)]) for r in p.rules), F.lit(p.name)) for p in enabled if p.rules]
    names = F.array_compact(F.array(*hit)) if hit else F.array().cast("array<string>")
    return fenced(tested, out, names).drop(*extra, *column.values())


def evaluate(df: DataFrame, policies: Sequence[Policy], text: str = "text", score: str | None = None,
             out: str = "policy") -> DataFrame:
    """Violations, worst action and worst severity as one struct column."""
    staged, forms, extra = with_forms(df, text, literals(policies))
    held = staged.withColumn("__found", violations_of(forms, policies, F.col(score) if score else None))
    found = F.col("__found")
    return fenced(held, out, F.when(F.col(text).isNotNull(), F.struct(
        (F.size(found) == 0).alias("passed"),
        found.alias("violations"),
        worst_of(found["action"], v.ACTIONS, "log").alias("action"),
        worst_of(found["severity"], v.SEVERITIES, "low").alias("severity"),
    ))).drop("__found", *extra)


def level_comparison(df: DataFrame, text: str = "text", levels: Sequence[str] = tuple(v.PRESETS)) -> DataFrame:
    """Violations and action of every preset level from one pass over the text."""
    staged, forms, extra = with_forms(df, text, literals(p for level in levels for p in preset(level)))
    held = staged.select("*", *(violations_of(forms, preset(level)).alias(f"__{level}") for level in levels))
    cols = []
    for level in levels:
        found = F.col(f"__{level}")
        cols += [F.size(found).alias(f"{level}_violations"),
                 worst_of(found["action"], v.ACTIONS, "log").alias(f"{level}_action"),
                 worst_of(found["severity"], v.SEVERITIES, "low").alias(f"{level}_severity")]
    return held.select("*", *cols).drop(*extra, *(f"__{level}" for level in levels))


def listing(spark: SparkSession, levels: Sequence[str] = tuple(v.PRESETS)) -> DataFrame:
    """Name, description, action, severity and rule count of the presets."""
    rules = None
    for level in levels:
        table = rules_table(spark, preset(level)).withColumn("level", F.lit(level))
        rules = table if rules is None else rules.unionByName(table)
    return rules.groupBy("level", F.col("policy").alias("name"), "description", "action", "severity").agg(
        F.count("rule_type").alias("rule_count"))
