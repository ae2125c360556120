"""Policy files: a JSON object with a ``policies`` list, read as a rule table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quietgate import fixed_values as v
from quietgate.functions.text import strings

FILE_SCHEMA = (
    "policies array<struct<name:string,description:string,action:string,severity:string,enabled:boolean,"
    "rules:array<struct<rule_type:string,description:string,pattern:string,keywords:array<string>,threshold:double>>>>"
)


def _checked(value: Column, allowed: tuple[str, ...], what: str) -> Column:
    """The value itself, an error for anything outside the vocabulary."""
    message = F.concat(F.lit(f"unknown {what}: "), F.coalesce(value, F.lit("missing")))
    return F.when(F.array_contains(strings(allowed), value), value).otherwise(F.raise_error(message).cast("string"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rule table of a policy file, or of all files of a folder in the order of their names."""
    return rules_of(spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name()), file="file")


def rules_of(files: DataFrame, column: str = "value", file: str | None = None) -> DataFrame:
    """One row per rule in evaluation order; a policy without rules keeps one row with null rule fields.

    Policies of several rows are numbered through in the order of ``file``; rules are configuration, a small table.
    """
    parsed = F.from_json(column, FILE_SCHEMA, {"mode": "FAILFAST"})
    name = F.lit("") if file is None else F.col(file)
    policies = files.select(name.alias("__file"), F.posexplode(parsed["policies"]).alias("policy_ord", "p"))
    policies = policies.withColumn("policy_ord", F.row_number().over(Window.orderBy("__file", "policy_ord")) - 1)
    rules = policies.select("policy_ord", "p", F.posexplode_outer("p.rules").alias("rule_ord", "r"))
    r, p = (lambda c: F.col(f"r.{c}")), (lambda c: F.col(f"p.{c}"))
    return rules.select(
        "policy_ord", F.when(p("name").isNull(), F.raise_error(F.lit("a policy needs a name")).cast("string"))
        .otherwise(p("name")).alias("policy"),
        F.coalesce(p("description"), F.lit("")).alias("description"),
        _checked(F.coalesce(p("action"), F.lit("block")), v.ACTIONS, "action").alias("action"),
        _checked(F.coalesce(p("severity"), F.lit("high")), v.SEVERITIES, "severity").alias("severity"),
        F.coalesce(p("enabled"), F.lit(True)).alias("enabled"),
        "rule_ord",
        F.when(F.col("r").isNotNull(), _checked(r("rule_type"), v.RULE_TYPES, "rule type")).alias("rule_type"),
        F.when(F.col("r").isNotNull(), F.coalesce(r("description"), F.lit(""))).alias("rule_description"),
        r("pattern").alias("pattern"), r("keywords").alias("keywords"), r("threshold").alias("threshold"))
