"""Exact histogram of encoded lengths, and what it answers for every context limit.

Documents are counted by length inside each task, so the shuffle carries one row per task and length.  Suffix sums run
over the histogram in two levels, over blocks of lengths and within each block, so no window holds all lengths.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quietgate.llm.common import Batches, Made, cut, in_slices, record
from quietgate.llm.tokens import Coder

BLOCK = 1024
_COUNT = pa.schema([("length", pa.int64()), ("docs", pa.int64())])


def _counted(path: str):
    def run(batches: Batches) -> Made:
        counts: Counter[int] = Counter()
        coder = Coder.of(path)
        for some in in_slices(batches, coder.forget):
            counts.update(len(ids) // 4 for ids in coder.encode(some.column("text").to_pylist()))
        yield record(_COUNT, list(counts), list(counts.values()))
    return run


def histogram(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """One row for every length that occurs.

    length; n_docs and n_tokens of that length; docs_at_least and tokens_at_least (the suffix sums); docs_at_most;
    truncated_tokens (all tokens kept when every document is cut to ``length``); lost_tokens (what that cuts off);
    total_docs and total_tokens.  Null and empty texts have length 0; repeated rows count each; an empty table gives no rows.
    Texts of any length are encoded whole; other columns are not read.
    """
    counted = docs.select(F.col(text).alias("text")).mapInArrow(_counted(vocabulary), "length bigint, docs bigint")
    # Used twice below; cut, so that the texts are encoded once.
    lengths = cut(counted.groupBy("length").agg(F.sum("docs").alias("n_docs"))).withColumns({
        "n_tokens": F.col("length") * F.col("n_docs"), "block": F.floor(F.col("length") / BLOCK)})
    sums = lengths.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    above = Window.orderBy(F.desc("block"))
    whole = Window.partitionBy()
    blocks = sums.select(
        "block", (F.sum("d").over(above) - F.col("d")).alias("d"), (F.sum("t").over(above) - F.col("t")).alias("t"),
        F.sum("d").over(whole).alias("total_docs"), F.sum("t").over(whole).alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("length"))
    summed = lengths.join(blocks, "block").withColumns({
        "docs_at_least": F.col("d") + F.sum("n_docs").over(inside), "tokens_at_least": F.col("t") + F.sum("n_tokens").over(inside)})
    kept = F.col("total_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")
    return summed.select(
        "length", "n_docs", "n_tokens", "docs_at_least", "tokens_at_least",
        (F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_at_most"),
        kept.alias("truncated_tokens"), (F.col("total_tokens") - kept).alias("lost_tokens"), "total_docs", "total_tokens")


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """One row: tokens kept when every document is cut to ``limit``, and documents longer than that."""
    over = F.col("length") > limit
    return hist.agg(
        F.coalesce(F.sum(F.least("length", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("kept_tokens"),
        F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("cut_docs"))


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least a share ``q`` of the documents does not exceed; null without documents."""
    return hist.where(F.col("docs_at_most") >= F.lit(q) * F.col("total_docs")).agg(F.min("length").alias("length"))
