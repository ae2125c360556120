"""Personal data: pattern spans of all types, names, one ordered entity array per text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quietgate import fixed_values as v
from quietgate.functions.text import exploded, fenced, rx, strings, with_forms, with_spans

Pattern = tuple[str, str, float]


def resolve_types(requested: Sequence[str] | None) -> list[str] | None:
    """Known types of a request; nothing known means all types."""
    known = [t for t in requested or () if t in v.PII_TYPES]
    return known or None


def pattern_list(custom: Mapping[str, Sequence[Mapping]] | None = None) -> list[Pattern]:
    """Built-in patterns with custom ones placed after those of their type, new types last."""
    custom = custom or {}
    extra = {t: [(t, c["pattern"], float(c.get("confidence", v.CUSTOM_PII_CONFIDENCE))) for c in rules]
             for t, rules in custom.items()}
    order = list(dict.fromkeys([t for t, *_ in v.PII_PATTERNS] + list(extra)))
    return [p for t in order for p in [b for b in v.PII_PATTERNS if b[0] == t] + extra.get(t, [])]


def chosen(entity_types: Sequence[str] | None, custom: Mapping | None) -> list[tuple[str, str, float, bool]]:
    """(type, pattern, confidence, ignore case) of the patterns to run, in detection order."""
    picked = [(t, p, c, True) for t, p, c in pattern_list(custom) if not entity_types or t in entity_types]
    if entity_types is None or v.NAME_TYPE in entity_types:
        picked += [(v.NAME_TYPE, p, v.NAME_CONFIDENCE, False) for p in v.NAME_PATTERNS]
    return picked


def _first_of_equal_spans(sorted_spans: Column) -> Column:
    return F.filter(sorted_spans, lambda e, i: (i == 0) | ~_same_span(F.get(sorted_spans, i - 1), e))


def _same_span(a: Column, b: Column) -> Column:
    return (a["start"] == b["start"]) & (a["end"] == b["end"])


def add_entities(df: DataFrame, text: str, entity_types: Sequence[str] | None = None, custom: Mapping | None = None,
                 out: str = "entities") -> DataFrame:
    """Entity array in two narrow steps: collect and sort spans, then keep the first found of equal spans.

    The field order (start, end, ord, ...) makes equal spans neighbours; the result is ordered by
    start, entities with the same start in detection order.
    """
    picked = chosen(entity_types, custom)
    staged, forms, extra = with_forms(df, text)
    found = with_spans(staged, forms.text, [(rx(p, fold), forms.may_match(p, fold)) for _, p, _, fold in picked], "__spans")
    collected = found.withColumn("__spans", F.array_sort("__spans")).drop(*extra)
    kinds = strings([t for t, *_ in picked])
    levels = F.array(*(F.lit(c) for _, _, c, _ in picked)) if picked else F.array().cast("array<double>")
    distinct = F.transform(_first_of_equal_spans(F.col("__spans")), lambda e: F.struct(
        e["start"].alias("start"), e["ord"].alias("ord"), e["end"].alias("end"),
        F.get(kinds, e["ord"]).alias("entity_type"), e["text"].alias("text"), F.get(levels, e["ord"]).alias("confidence")))
    return fenced(collected, out, F.when(F.col(text).isNotNull(), F.array_sort(distinct))).drop("__spans")


def detect(df: DataFrame, text: str = "text", entity_types: Sequence[str] | None = None,
           custom_patterns: Mapping | None = None, out: str = "entities") -> DataFrame:
    """Entities of every text, ordered by position."""
    return add_entities(df, text, entity_types, custom_patterns, out)


def entity_table(df: DataFrame, keys: Sequence[str], entities: str = "entities") -> DataFrame:
    """One row per entity."""
    return exploded(df, keys, entities, "pos", "e").select(*keys, "pos", "e.entity_type", "e.text", "e.start", "e.end", "e.confidence")


def by_type(df: DataFrame, entities: str = "entities", out: str = "by_type") -> DataFrame:
    """Entities of a text grouped by type, in the row itself: map of type to entities in order of appearance."""
    e = F.col(entities)
    types = F.array_distinct(F.transform(e, lambda x: x["entity_type"]))
    grouped = F.map_from_entries(F.transform(types, lambda t: F.struct(
        t.alias("key"), F.filter(e, lambda x: x["entity_type"] == t).alias("value"))))
    return df.withColumn(out, grouped)


def type_counts(df: DataFrame, by: Sequence[str], entities: str = "entities") -> DataFrame:
    """Entities and texts per group and type.

    Counted inside each row first, so only one small record per text and type reaches the aggregation,
    which combines on the map side: a group holding most of the rows stays cheap.
    """
    e = F.col(entities)
    types = F.array_distinct(F.transform(e, lambda x: x["entity_type"]))
    per_row = F.transform(types, lambda t: F.struct(
        t.alias("entity_type"), F.size(F.filter(e, lambda x: x["entity_type"] == t)).alias("n")))
    return exploded(df, by, per_row, "pos", "c").groupBy(*by, "c.entity_type").agg(
        F.sum("c.n").alias("entities"), F.count("*").alias("texts"))
