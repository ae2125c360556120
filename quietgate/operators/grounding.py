"""Claims of a text and how well a context supports them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quietgate import fixed_values as v
from quietgate.functions.text import any_of, exploded, fenced, let, places, sentences, strings, strip, words

VERIFIED_TYPE = "array<struct<claim:string,is_supported:boolean,confidence:double,supporting_context:string>>"


def claims_of(text: Column) -> Column:
    """Sentences that state something: long enough, no question, no filler opening."""

    def states(sentence: Column) -> Column:
        filler = any_of(F.lower(sentence).startswith(opening) for opening in v.FILLER_OPENINGS)
        return (F.char_length(sentence) >= v.CLAIM_MIN_CHARS) & ~sentence.endswith("?") & ~filler

    return F.filter(sentences(text), states)


Contains = Callable[[Column], Column]  # whether the context has a lower-cased string


def contains_of(context_lower: Column, known: Column | None = None) -> Contains:
    """Containment in a context of the row; where ``known`` is not null, it lists what a context elsewhere contains."""
    inside = lambda w: context_lower.contains(w)
    return inside if known is None else lambda w: F.coalesce(F.array_contains(known, w), inside(w))


def share_contained(items: Column, contains: Contains) -> Column:
    """Share of strings that occur in the context; the caller makes sure there are some."""
    return F.size(F.filter(items, contains)).cast("double") / F.size(items).cast("double")


def fragments_of(claim: Column) -> Column:
    """Lower-cased 20-character windows every 10 characters."""
    last = F.char_length(claim) - v.FRAGMENT_CHARS + 1
    starts = F.sequence(F.lit(1), last, F.lit(v.FRAGMENT_STEP))
    return F.transform(starts, lambda i: F.lower(F.substring(claim, i, F.lit(v.FRAGMENT_CHARS))))


def meaningful_words(claim: Column) -> Column:
    return F.array_except(words(F.lower(claim)), strings(v.CLAIM_STOP_WORDS))


def items_of(output: Column) -> Column:
    """The strings ``verify`` looks for in the context: words and fragments of all claims."""
    return F.array_distinct(F.flatten(F.transform(claims_of(output), lambda c: F.concat(meaningful_words(c), F.when(
        F.char_length(c) >= v.FRAGMENT_CHARS, fragments_of(c)).otherwise(F.array().cast("array<string>"))))))


def support_score(claim: Column, contains: Contains) -> Column:
    """0.6 x share of words found + 0.4 x share of fragments found, null when the claim has no words."""

    def scored(meaningful: Column) -> Column:
        fragments = F.when(
            F.char_length(claim) >= v.FRAGMENT_CHARS, let(fragments_of(claim), lambda f: share_contained(f, contains))
        ).otherwise(F.lit(0.0))
        return F.when(
            F.size(meaningful) > 0,
            share_contained(meaningful, contains) * F.lit(v.WORD_SHARE) + fragments * F.lit(v.FRAGMENT_SHARE))

    return let(meaningful_words(claim), scored)


def last_window(chars: Column) -> Column:
    """Number of the last snippet window of a context of that many characters."""
    last = F.greatest(F.lit(1), chars - v.SNIPPET_CHARS) - 1
    return F.call_function("div", last, F.lit(v.SNIPPET_STEP)).cast("int")


def windows_with(at: Column, size: Column, last: Column) -> Column:
    """Numbers of the snippet windows that a string of ``size`` characters at ``at`` lies in."""
    first = F.greatest(F.ceil((at + size - v.SNIPPET_CHARS) / v.SNIPPET_STEP), F.lit(0)).cast("int")
    upto = F.least(F.call_function("div", at, F.lit(v.SNIPPET_STEP)).cast("int"), last)
    return F.when(first <= upto, F.sequence(first, upto)).otherwise(F.array().cast("array<int>"))


def best_snippet(claim: Column, context: Column, context_lower: Column) -> Column:
    """First context window with the most claim words, null when no window has any.

    The words' places in the context give the numbers of the windows that hold them; a window counts once for a word.
    """
    last = last_window(F.char_length(context))

    def held(word: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(
            places(context_lower, word), lambda at: windows_with(at, F.char_length(word), last))))

    def most_frequent(numbers: Column) -> Column:
        """Of sorted numbers the one that occurs most often, the smallest of several."""
        none = F.lit(-1)
        return F.aggregate(
            numbers, F.struct(none.alias("k"), F.lit(0).alias("n"), none.alias("best"), F.lit(0).alias("most")),
            lambda acc, k: let(F.when(acc["k"] == k, acc["n"] + 1).otherwise(F.lit(1)), lambda n: F.struct(
                k.alias("k"), n.alias("n"), F.when(n > acc["most"], k).otherwise(acc["best"]).alias("best"),
                F.greatest(n, acc["most"]).alias("most"))),
            lambda acc: acc["best"])

    best = most_frequent(F.array_sort(F.flatten(F.transform(words(F.lower(claim)), held))))
    return let(best, lambda k: F.when(k >= 0, strip(F.substring(
        context, k * v.SNIPPET_STEP + 1, F.lit(v.SNIPPET_CHARS)))))


def verified_of(claims: Column, context: Column, context_lower: Column, contains: Contains) -> Column:
    """Verdict per claim, in order.  The context stays in the row: nothing is copied per claim."""

    def verdict(claim: Column) -> Column:
        def finish(score: Column) -> Column:
            supported = score.isNull() | (score >= F.lit(v.CLAIM_SUPPORT))
            snippet = F.when(score >= F.lit(v.CLAIM_SUPPORT), best_snippet(claim, context, context_lower))
            return F.struct(claim.alias("claim"), supported.alias("is_supported"),
                            F.coalesce(score, F.lit(v.CLAIM_DEFAULT)).alias("confidence"),
                            snippet.alias("supporting_context"))
        return let(support_score(claim, contains), finish)

    return F.transform(claims, verdict)


def verify(df: DataFrame, output: str = "output", context: str = "context", out: str = "verified",
           known: str | None = None) -> DataFrame:
    """Claims of ``output`` checked against ``context`` as an array of verdicts.

    ``known`` names an array of the strings that a context kept elsewhere contains (``plans.evidence``); rows that have
    one need no context and get no snippets here.
    """
    staged = df.select("*", claims_of(F.col(output)).alias("__claims"), F.lower(context).alias("__ctx"))
    contains = contains_of(F.col("__ctx"), None if known is None else F.col(known))
    return fenced(
        staged, out, verified_of(F.col("__claims"), F.col(context), F.col("__ctx"), contains).cast(VERIFIED_TYPE)
    ).drop("__claims", "__ctx")


def score(df: DataFrame, verified: str = "verified", out: str = "hallucination") -> DataFrame:
    """Totals and the share of unsupported claims, from the verdicts in the row."""
    staged = df.withColumn("__bad", F.size(F.filter(verified, lambda x: ~x["is_supported"])))
    total, bad = F.size(verified), F.col("__bad")
    share = F.when(total > 0, bad.cast("double") / total.cast("double")).otherwise(F.lit(0.0))
    return fenced(staged, out, F.when(F.col(verified).isNotNull(), F.struct(
        total.alias("total_claims"), (total - bad).alias("supported_claims"), bad.alias("unsupported_claims"),
        share.alias("hallucination_score"), (bad > 0).alias("has_hallucinations")))).drop("__bad")


def claim_table(df: DataFrame, keys: list[str], verified: str = "verified") -> DataFrame:
    return exploded(df, keys, verified, "claim_no", "c").select(*keys, "claim_no", "c.*")


JUDGE_SCHEMA = "is_supported boolean, confidence double, supporting_text string"


def merge_judge(claims: DataFrame, reply: str) -> DataFrame:
    """Replace a claim's verdict by an external judge's JSON reply where that parses to an object."""
    staged = claims.withColumn("__reply", F.from_json(reply, JUDGE_SCHEMA))
    said = F.col("__reply")
    parsed = F.try_parse_json(F.col(reply)).isNotNull() & F.json_object_keys(reply).isNotNull()
    pick = lambda theirs, ours: F.when(parsed, theirs).otherwise(F.col(ours))
    return (staged.withColumn("__ok", parsed)
            .withColumn("is_supported", pick(F.coalesce(said["is_supported"], F.lit(False)), "is_supported"))
            .withColumn("confidence", pick(F.coalesce(said["confidence"], F.lit(0.0)), "confidence"))
            .withColumn("supporting_context", pick(said["supporting_text"], "supporting_context"))
            .drop("__reply", "__ok"))
