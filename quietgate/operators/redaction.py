"""Redaction of entity spans with four strategies, a replacement map, and its reversal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quietgate import fixed_values as v
from quietgate.functions.text import exploded, fenced, let, replace_from_right, totals_before
from quietgate.operators import pii

STRATEGIES = ("mask", "hash", "placeholder", "anonymize")


def from_the_end(entities: Column) -> Column:
    """Entities by start descending; those with the same start keep their detection order."""
    flipped = F.transform(entities, lambda e, i: F.struct(
        (-e["start"]).alias("back"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(flipped), lambda f: f["e"])


def numbered(ordered: Column) -> Column:
    """Pair every entity with its running number within its type."""

    def ranked(by_type: Column) -> Column:
        types = F.array_distinct(F.transform(by_type, lambda x: x["kind"]))
        firsts = F.map_from_arrays(types, F.transform(
            types, lambda t: F.size(F.filter(by_type, lambda x: x["kind"] < t))))
        return let(firsts, lambda first: F.transform(F.array_sort(F.transform(by_type, lambda x, j: F.struct(
            x["i"].alias("i"), (j - F.element_at(first, x["kind"]) + 1).alias("n"), x["e"].alias("e")))),
            lambda x: F.struct(x["e"].alias("e"), x["n"].alias("n"))))

    tagged = F.transform(ordered, lambda e, i: F.struct(e["entity_type"].alias("kind"), i.alias("i"), e.alias("e")))
    return let(F.array_sort(tagged), ranked)


def replacement_of(strategy: str, entity: Column, number: Column | None, mask_text: str = v.MASK_TEXT) -> Column:
    if strategy == "hash":
        return F.concat(F.lit("[HASH:"), F.substring(F.sha2(entity["text"], 256), 1, v.HASH_DIGITS), F.lit("]"))
    if strategy == "placeholder":
        return F.concat(F.lit("["), entity["entity_type"], F.lit("_"), number.cast("string"), F.lit("]"))
    if strategy == "anonymize":
        out = F.lit(v.ANONYMIZED)
        for kind, options in v.STAND_INS.items():
            picked = F.element_at(F.array(*map(F.lit, options)), F.pmod(number - 1, F.lit(len(options))) + 1)
            out = F.when(entity["entity_type"] == kind, picked).otherwise(out)
        return out
    return F.lit(mask_text)


def replacements(entities: Column, strategy: str, mask_text: str = v.MASK_TEXT) -> Column:
    """Spans from the end of the text backwards, each with its replacement."""
    ordered = from_the_end(entities)

    def entry(e: Column, n: Column | None) -> Column:
        return F.struct(e["start"].alias("start"), e["end"].alias("end"), e["entity_type"].alias("entity_type"),
                        e["text"].alias("original"), replacement_of(strategy, e, n, mask_text).alias("replacement"))

    if strategy in ("placeholder", "anonymize"):
        return let(ordered, lambda o: F.transform(numbered(o), lambda p: entry(p["e"], p["n"])))
    return F.transform(ordered, lambda e: entry(e, None))


def merged_spans(entities: Column) -> Column:
    """Overlapping spans fused into one of the first one's type, for callers that want clean text."""
    return F.aggregate(
        F.slice(entities, 2, F.greatest(F.size(entities), F.lit(1))),
        F.slice(entities, 1, 1),
        lambda acc, e: let(F.element_at(acc, -1), lambda last: F.when(
            e["start"] < last["end"],
            F.array_append(
                F.slice(acc, 1, F.size(acc) - 1),
                last.withField("text", F.concat(last["text"], F.when(
                    e["end"] > last["end"],
                    F.substring(e["text"], last["end"] - e["start"] + 1, e["end"] - last["end"])).otherwise(F.lit(""))))
                .withField("end", F.greatest(last["end"], e["end"]))),
        ).otherwise(F.array_append(acc, e))),
    )


def redact_entities(df: DataFrame, text: str, entities: str, strategy: str = "mask", mask_text: str = v.MASK_TEXT,
                    merge_overlaps: bool = False, out: str = "redacted") -> DataFrame:
    """Redact the given entity array; adds the text and the replacement list."""
    source = F.when(F.size(entities) > 0, merged_spans(F.col(entities))).otherwise(F.col(entities)) \
        if merge_overlaps else F.col(entities)
    listed = fenced(df, f"{out}_spans", replacements(source, strategy, mask_text))
    spans = F.col(f"{out}_spans")
    return listed.withColumn(
        out, F.when(F.size(spans) > 0, replace_from_right(F.col(text), spans, lambda s: s["replacement"]))
        .otherwise(F.col(text)))


def redact(df: DataFrame, text: str = "text", strategy: str = "mask", entity_types: Sequence[str] | None = None,
           mask_text: str = v.MASK_TEXT, merge_overlaps: bool = False, out: str = "redacted") -> DataFrame:
    """Detect and redact; adds ``entities``, the redacted text and the replacement list."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    found = pii.detect(df, text, entity_types)
    return redact_entities(found, text, "entities", strategy, mask_text, merge_overlaps, out)


def redact_given(texts: DataFrame, spans: DataFrame, key: str, text: str = "text", strategy: str = "mask",
                 mask_text: str = v.MASK_TEXT, out: str = "redacted") -> DataFrame:
    """Redact spans supplied as a table (key, ord, entity_type, text, start, end).

    The span rows of one text end up in its row, as the text itself does; keys are unique on
    both sides of the join, so no key can grow it.
    """
    per_text = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        "start", "ord", "end", "entity_type", F.col("text").alias("text")))).alias("__given"))
    joined = texts.join(per_text, key, "left").withColumn(
        "__given", F.coalesce("__given", F.array().cast(
            "array<struct<start:int,ord:bigint,end:int,entity_type:string,text:string>>")))
    return redact_entities(joined, text, "__given", strategy, mask_text, out=out).drop("__given")


def replacement_map(spans: Column) -> Column:
    """Distinct replacements in order of first use with the original written last.

    Sorted by replacement and position, the uses of a replacement lie side by side: the first gives its place, the last
    its original.
    """
    uses = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["replacement"].alias("r"), i.alias("i"), s["original"].alias("o"))))

    def paired(u: Column) -> Column:
        other = lambda j, x: F.coalesce(F.get(u, j)["r"] != x["r"], F.lit(True))
        firsts = F.filter(u, lambda x, j: other(F.when(j > 0, j - 1), x))
        lasts = F.filter(u, lambda x, j: other(j + 1, x))
        return F.array_sort(F.zip_with(firsts, lasts, lambda a, b: F.struct(
            a["i"].alias("i"), a["r"].alias("replacement"), b["o"].alias("original"))))

    return F.transform(let(uses, paired), lambda m: F.struct(m["replacement"].alias("replacement"), m["original"].alias("original")))


def mapping_table(df: DataFrame, key: str, spans: str = "redacted_spans") -> DataFrame:
    """The replacement map as a side table (key, ord, replacement, original)."""
    return exploded(df, [key], replacement_map(F.col(spans)), "ord", "m").select(
        key, "ord", "m.replacement", "m.original")


def places_table(df: DataFrame, key: str, spans: str = "redacted_spans") -> DataFrame:
    """Every replacement with its place in the redacted text: (key, ord, replacement, original, start, end).

    Overlapping spans damage each other's replacements, which then have no place: their texts get null ones.
    """
    ordered = F.reverse(F.col(spans))  # spans run from the end of the text
    crossing = F.exists(F.transform(ordered, lambda s, i: (i > 0) & (s["start"] < F.get(ordered, i - 1)["end"])), lambda x: x)
    grown = F.transform(ordered, lambda s: F.char_length(s["replacement"]) - (s["end"] - s["start"]))
    placed = F.zip_with(ordered, totals_before(grown), lambda s, by: F.struct(
        s["replacement"].alias("replacement"), s["original"].alias("original"), (s["start"] + by).alias("start"),
        (s["start"] + by + F.char_length(s["replacement"])).alias("end")))
    unplaced = F.transform(ordered, lambda s: F.struct(
        s["replacement"].alias("replacement"), s["original"].alias("original"), F.lit(None).cast("int").alias("start"),
        F.lit(None).cast("int").alias("end")))
    return exploded(df, [key], F.when(crossing, unplaced).otherwise(placed), "ord", "m").select(key, "ord", "m.*")


def reverse_placed(redacted: DataFrame, places: DataFrame, key: str, text: str = "redacted", out: str = "restored") -> DataFrame:
    """Put every original back at its place, in one pass over the text, whatever the strategy.

    ``places`` is a ``places_table``.  Unlike a map, it tells equal replacements of different originals apart.  Texts
    whose replacements have no place are restored by their map, the last original of a replacement winning.
    """
    per_text = places.groupBy(key).agg(F.array_sort(F.collect_list(
        F.struct("start", "end", "ord", "replacement", "original"))).alias("__places"))
    staged = redacted.join(per_text, key, "left")
    known = F.forall("__places", lambda p: p["start"].isNotNull())
    pieces = replace_from_right(F.col(text), F.reverse("__places"), lambda p: p["original"])
    listed = F.transform(F.array_sort(F.transform("__places", lambda p: F.struct(p["ord"].alias("ord"), p.alias("p")))), lambda x: x["p"])
    folded = F.aggregate(replacement_map(F.reverse(listed)), F.col(text), lambda acc, m: F.replace(acc, m["replacement"], m["original"]))
    restored = F.when(F.col("__places").isNull(), F.col(text)).when(known, pieces).otherwise(folded)
    return fenced(staged, out, restored).drop("__places")


_NUMBERED = r"\[([A-Z_]+)_([0-9]+)\]"


def _number(token: Column) -> Column:
    return F.regexp_extract(token, _NUMBERED, 2).try_cast("int")


def _originals(mapping: Column, kind: str) -> Column:
    """(n, original) of the numbered replacements of one type, in order of their numbers."""
    own = F.filter(mapping, lambda m: m["replacement"].startswith(f"[{kind}_"))
    return F.array_sort(F.transform(own, lambda m: F.struct(_number(m["replacement"]).alias("n"), m["original"].alias("original"))))


def reverse(redacted: DataFrame, mapping: DataFrame, key: str, text: str = "redacted",
            out: str = "restored") -> DataFrame:
    """Put originals back, one replacement after the other in mapping order.

    Numbered placeholders, 1 to n for each type and with no bracket in any original, cannot affect each other: these are
    put back in one pass over the text, found by their number.  Other mappings are folded, which copies the text for
    every replacement.
    """
    per_text = mapping.groupBy(key).agg(F.array_sort(F.collect_list(
        F.struct("ord", "replacement", "original"))).alias("__map"))
    joined = redacted.join(per_text, key, "left")
    kinds = {kind: f"__{kind}" for kind in v.PII_TYPES}
    staged = joined.select("*", *(_originals(F.col("__map"), kind).alias(name) for kind, name in kinds.items()))

    known = "|".join(kinds)
    apart = F.forall("__map", lambda m: m["replacement"].rlike(rf"^\[(?:{known})_[1-9][0-9]*\]$") & ~m["original"].contains("["))
    counted = F.lit(True)
    for name in kinds.values():
        counted = counted & ((F.size(name) == 0) | (F.element_at(name, -1)["n"] == F.size(name)) & (F.get(name, F.lit(0))["n"] == 1))

    def back(token: Column) -> Column:
        number, original = _number(token), F.lit(None).cast("string")
        for kind, name in kinds.items():
            mine = token == F.concat(F.lit(f"[{kind}_"), number.cast("string"), F.lit("]"))
            original = F.when(mine, F.get(F.col(name), number - 1)["original"]).otherwise(original)
        return F.coalesce(original, token)

    tokens = F.concat(F.transform(F.regexp_extract_all(text, F.lit(_NUMBERED), F.lit(0)), back), F.array(F.lit("")))
    one_pass = F.array_join(F.zip_with(F.split(text, _NUMBERED, -1), tokens, lambda gap, token: F.concat(gap, token)), "")
    folded = F.aggregate(F.col("__map"), F.col(text), lambda acc, m: F.replace(acc, m["replacement"], m["original"]))
    restored = F.when(F.col("__map").isNull(), F.col(text)).when(apart & counted, one_pass).otherwise(folded)
    return fenced(staged, out, restored).drop("__map", *kinds.values())
