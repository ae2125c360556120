"""Joins that build (prompt, output, context) rows from conversation and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quietgate.functions.running import running_sums, slice_of, with_previous

SLICE = 16_384  # turns of one conversation that share a window group; the group spills, the carried rows stay few


def pair_turns(turns: DataFrame) -> DataFrame:
    """Every assistant turn with the user turn directly before it.

    ``turns`` has ``conv_id, turn, role, text``.  Neighbours are found inside ranges of a
    conversation, so a conversation of any length spreads over tasks.  Turns without a ``conv_id`` are one conversation.
    """
    near = with_previous(turns, ["conv_id"], "turn", None, ["role", "text"])
    return near.where((F.col("role") == "assistant") & (F.col("prev_role") == "user")).select(
        "conv_id", "turn", F.col("prev_text").alias("prompt"), F.col("text").alias("output"))


def longest_conversation(turns: DataFrame) -> int:
    """Turns of the longest conversation: with this many, ``attach_context`` leaves nothing out."""
    return turns.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 1


def attach_context(turns: DataFrame, last: int, separator: str = "\n") -> DataFrame:
    """Every turn with the text of up to ``last`` turns before it, oldest first, null at the start.

    ``context_cut`` tells whether earlier turns were left out.  Turns are numbered without gaps first; slices then
    follow the numbers and the tail of each slice is copied into the next one, where the first turns look back at it.
    """
    if last < 1:
        raise ValueError("last must be at least 1")
    size = max(SLICE, last)
    numbered = running_sums(turns, ["conv_id"], ["turn"], None, {"__no": F.lit(1)})
    own = slice_of(F.col("__no"), size)
    tail = F.pmod(F.col("__no"), F.lit(size)) >= size - last
    placed = numbered.withColumn("__own", own).select(
        "*", F.explode(F.when(tail, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))).alias("__slice"))
    before = Window.partitionBy("conv_id", "__slice").orderBy("__no").rowsBetween(-last, -1)
    texts = F.collect_list("text").over(before)
    return placed.withColumn("__before", texts).where(F.col("__slice") == F.col("__own")).select(
        *turns.columns, F.when(F.size("__before") > 0, F.array_join("__before", separator)).alias("context"),
        (F.col("__no") > last + 1).alias("context_cut"))


def attach_document(outputs: DataFrame, documents: DataFrame, key: str, document_key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """Outputs with the text of the document they name; outputs without one keep a null context."""
    contexts = documents.select(F.col(document_key).alias(key), F.col(text).alias("context"))
    return outputs.join(contexts, key, "left")
