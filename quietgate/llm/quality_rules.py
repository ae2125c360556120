"""Host-level quality rules: failures per host, shrunk to what hosts are like, and verdicts joined back to documents.

Built-in functions only.  Words are hashed once per text; the hash of an 8-word window comes from three doublings (2, 4,
8 words).  Only texts that have a window twice sort their windows.  Costly arrays stand behind a one-element explode, so
that no later expression evaluates them again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quietgate.functions.text import let
from quietgate.llm.common import GAP, cut, small

WINDOW = 8
HOST_LIMIT = 0.5     # a host that fails a rule more often is rejected as a whole
COMMON_LIMIT = 0.02  # where failing a rule is this common, a document that fails it is rejected
WEAK_PRIOR = 2.0     # prior documents per host where hosts differ by no more than chance
BROADCAST_HOSTS = 100_000
#: Rules of a document, from the columns that ``measured`` returns.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_dup_lines >= 4 and n_dup_lines * 20 > n_words",
    "odd_word_length": "word_chars < 3 * n_words or word_chars > 12 * n_words",
}


def _held(df: DataFrame, name: str, value: Column, *keep: Column | str) -> DataFrame:
    return df.select(*keep, F.explode_outer(F.array(value)).alias(name))


def _paired(name: str, apart: int) -> Column:
    """Hash of every item and the item ``apart`` places later, as long as there is one."""
    last = F.size(name) - apart
    return F.when(last > 0, F.transform(
        F.slice(name, 1, F.greatest(last, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(F.col(name), i + apart)))
    ).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words that lie in a window which occurs twice or more."""
    ordered = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def places(o: Column) -> Column:
        same = lambda s, j: F.coalesce(F.get(o, j)["x"] == s["x"], F.lit(False))
        twice = F.filter(o, lambda s, j: ((j > 0) & same(s, F.greatest(j - 1, F.lit(0)))) | same(s, j + 1))
        return F.array_sort(F.transform(twice, lambda s: s["i"]))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda at, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - at, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return let(let(ordered, places), total)


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(key, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every row; a null text counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = docs.select(F.col(key).alias("key"), F.col(host).cast("string").alias("host"), whole.alias("text"))
    rows = _held(rows.withColumn("lines", lines), "words", F.array_remove(F.split("text", GAP), ""), "key", "host",
                 F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
                 F.when(F.instr("text", "\n") > 0, F.size("lines") - F.size(F.array_distinct("lines"))).otherwise(0)
                 .cast("bigint").alias("n_dup_lines"))
    stats = ["key", "host", "n_symbols", "n_dup_lines", "n_words", "word_chars"]
    rows = _held(rows, "w1", F.transform("words", lambda w: F.xxhash64(w)), *stats[:4],
                 F.size("words").cast("bigint").alias("n_words"),
                 F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"))
    for size in (1, 2, 4):
        rows = _held(rows, f"w{2 * size}", _paired(f"w{size}", size), *stats)
    repeated = F.when(F.size(F.array_distinct("w8")) < F.size("w8"), _covered(F.col("w8"))).otherwise(0)
    return rows.select(*stats, repeated.cast("bigint").alias("n_repeat_words"))


def _beta(rates: DataFrame, rule: str) -> list[Column]:
    """Beta prior of a rule by the moments of the hosts' rates; hosts that hardly differ give a weak one at their mean."""
    mean, spread = F.avg(f"{rule}_rate"), F.var_pop(f"{rule}_rate")
    strength = F.when(spread > 0, F.greatest(mean * (1 - mean) / spread - 1, F.lit(WEAK_PRIOR))).otherwise(F.lit(WEAK_PRIOR))
    return [(mean * strength).alias(f"{rule}_a"), ((1 - mean) * strength).alias(f"{rule}_b")]


def host_verdicts(stats: DataFrame) -> DataFrame:
    """One row per host: n_docs, and for every rule the shrunk failure rate; rejected where one exceeds HOST_LIMIT.

    The counts are combined inside each task before the shuffle, so one host with most of the rows stays cheap.
    """
    counted = stats.groupBy("host").agg(F.count("*").alias("n_docs"), *(
        F.sum(F.expr(rule).cast("int")).alias(f"{name}_failed") for name, rule in RULES.items()))
    rates = cut(counted.withColumns({f"{name}_rate": F.col(f"{name}_failed") / F.col("n_docs") for name in RULES}))
    prior = rates.agg(*(c for name in RULES for c in _beta(rates, name)))
    first = prior.first()  # one row of parameters
    known = {n: (first[f"{n}_a"] or 0.0, first[f"{n}_b"] or 0.0) for n in RULES}
    shrunk = {n: (F.col(f"{n}_failed") + a) / (F.col("n_docs") + a + b) for n, (a, b) in known.items()}
    return rates.select("host", "n_docs", *(c.alias(f"{n}_rate") for n, c in shrunk.items()),
                        F.greatest(*shrunk.values()).alias("worst_rate")).withColumn("host_rejected", F.col("worst_rate") > HOST_LIMIT)


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Counts and verdict of every row: key, host, the counts, base_failed, host_rejected, worst_rate, kept.

    A row is dropped if it fails the base rules, if its host is rejected, or if it fails a rule that documents of its
    host commonly fail.  Rows without a host form a host of their own; null and empty texts fail; a null key stays
    null; repeated rows count each; an empty table gives no rows.  Texts of any length are measured whole; other columns
    are not read.
    """
    stats = cut(measured(docs, key, text, host))
    hosts = host_verdicts(stats)
    side = F.broadcast(hosts) if small(hosts, BROADCAST_HOSTS) else hosts
    joined = stats.alias("s").join(side.alias("h"), F.col("s.host").eqNullSafe(F.col("h.host")), "left")
    common = F.lit(False)
    for name, rule in RULES.items():
        common = common | (F.expr(rule) & (F.col(f"{name}_rate") > COMMON_LIMIT))
    base = F.expr(f"({RULES['few_words']}) or ({RULES['repeated_windows']})")
    return joined.select(
        F.col("s.key").alias(key), F.col("s.host").alias(host), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", base.alias("base_failed"), "host_rejected", "worst_rate",
        (~base & ~F.coalesce("host_rejected", F.lit(False)) & ~common).alias("kept"))
