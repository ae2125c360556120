"""Outputs checked against all that was said before them in their conversation, without gathering it.

The first turns of a conversation are short enough to stand in a row with an output: these contexts are bounded in
characters.  Further on, nothing is concatenated.  The context of a turn is the beginning of its conversation, up to a
known length, so a string is in it if its first occurrence in the conversation ends before that length.  Conversations
are cut into pieces of bounded size along their characters, each with the beginning of the next one, so that a string
may reach over any number of short turns; pieces are looked up for all wanted strings of their conversation at once, by
equality of the strings' first letters.  No row holds more than a piece or an output, no key more than a piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quietgate import fixed_values as v
from quietgate.functions.running import running_sums
from quietgate.functions.text import strip, words
from quietgate.operators import grounding

CONTEXT_CHARS = 16_384  # of a context that is put into a row
PIECE_CHARS = 2048      # that a piece begins with
LOOK_AHEAD = 48         # characters carried from every place, 8 at least; longer strings are compared with their piece
_div = lambda a, b: F.call_function("div", a, F.lit(b))


def _placed(turns: DataFrame) -> DataFrame:
    """Turns with their beginning in the joined conversation, in characters as they are and in lower case."""
    size = lambda c: F.when(F.col("text").isNotNull(), F.char_length(c) + 1).otherwise(F.lit(0))
    raw, low = size(F.col("text")), size(F.lower("text"))
    summed = running_sums(turns.select("conv_id", "turn", "text"), ["conv_id"], ["turn"], None, {"__raw": raw, "__low": low})
    return summed.select("conv_id", "turn", "text", (F.col("__raw") - raw).alias("begin"), (F.col("__low") - low).alias("low_begin"))


def _contexts(placed: DataFrame, most: int) -> DataFrame:
    """(conv_id, turn, context) of the turns whose context has at most ``most`` characters, null at the start."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    early = placed.where(F.col("begin") <= most + 1).withColumn("__before", F.collect_list("text").over(before))
    return early.select("conv_id", "turn", F.when(F.size("__before") > 0, F.array_join("__before", "\n")).alias("context"))


def with_earlier(outputs: DataFrame, turns: DataFrame, items: Column, most: int = CONTEXT_CHARS) -> tuple[DataFrame, DataFrame | None]:
    """``outputs`` with ``context`` or ``known``, and the places that further checks need, or None.

    ``outputs`` has ``conv_id, turn``, ``turns`` has ``conv_id, turn, text``, both one row for each turn.  ``context``
    holds all earlier turns, joined by line feeds, where that takes at most ``most`` characters, and null for turns
    without any.  Later turns get no context but ``known``: those of their ``items``, an array of lower-cased words and
    fragments of the output, that occur in the earlier turns.  Outputs without a conversation or a turn are left out.
    """
    placed = _placed(turns)
    none = F.lit(None).cast("array<string>")
    near = outputs.join(_contexts(placed, most), ["conv_id", "turn"]).withColumn("known", none)
    sizes = turns.groupBy("conv_id").agg(F.sum(F.char_length("text") + 1).alias("size"))
    if sizes.where(F.col("size") > most + 1).isEmpty():
        return near, None
    late = placed.where(F.col("begin") > most + 1).select("conv_id", "turn", "begin", "low_begin")
    far = outputs.join(late, ["conv_id", "turn"])
    asked = far.select("conv_id", "turn", "low_begin", F.explode(F.array_distinct(items)).alias("item"))
    said = placed.join(far.select("conv_id").distinct(), "conv_id", "left_semi").where("text is not null")
    first = occurrences(asked.select("conv_id", "item").distinct(), said).groupBy("conv_id", "item").agg(F.min("at").alias("at"))
    known = asked.join(first, ["conv_id", "item"]).where(F.col("at") + F.char_length("item") <= F.col("low_begin") - 1)
    listed = known.groupBy("conv_id", "turn").agg(F.collect_list("item").alias("__known"))
    told = far.join(listed, ["conv_id", "turn"], "left").select(
        *outputs.columns, F.lit(None).cast("string").alias("context"), F.coalesce("__known", F.array().cast("array<string>")).alias("known"))
    return near.select(*outputs.columns, "context", "known").unionByName(told), placed


def pieces(said: DataFrame, text: Column, begin: str, over: int, size: int = PIECE_CHARS) -> DataFrame:
    """(conv_id, piece, said): characters ``piece * size`` to ``(piece + 1) * size + over`` of the joined conversation.

    Every turn is followed by a line feed.  Piece by piece, the turns' shares are put together in order.
    """
    whole = F.concat(text, F.lit("\n"))
    begins, ends = F.col(begin), F.col(begin) + F.char_length("__whole")
    numbered = said.withColumn("__whole", whole).select("conv_id", begin, "__whole", F.explode(F.sequence(
        _div(F.greatest(begins - over, F.lit(0)), size), _div(ends - 1, size))).alias("piece"))
    since = F.greatest(F.col("piece") * size - begins, F.lit(0)).cast("int")
    upto = (F.least((F.col("piece") + 1) * size + over, ends) - begins).cast("int")
    shares = numbered.select("conv_id", "piece", (begins + since).alias("at"), F.substring("__whole", since + 1, upto - since).alias("part"))
    gathered = shares.where(F.col("part") != "").groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("s"))
    return gathered.select("conv_id", "piece", F.array_join(F.transform("s", lambda x: x["part"]), "").alias("said"))


def _anchor_size(item: Column) -> Column:
    size = F.char_length(item)
    return F.when(size >= 8, F.lit(8)).when(size >= 4, F.lit(4)).otherwise(size)


def occurrences(wanted: DataFrame, said: DataFrame) -> DataFrame:
    """(conv_id, item, at) of every place, from 0 on, where an item occurs in its lower-cased conversation.

    ``wanted`` has distinct ``conv_id, item``; ``said`` has ``conv_id, text, low_begin``.
    """
    anchored = wanted.where(F.col("item") != "").withColumn("__size", _anchor_size(F.col("item")))
    shape = anchored.agg(F.max(F.char_length("item")), F.sort_array(F.collect_set("__size"))).first()  # five sizes at most
    longest, sizes = shape[0] or 1, shape[1] or [1]
    size, look = max(PIECE_CHARS, longest), min(longest, LOOK_AHEAD)
    cut = pieces(said, F.lower("text"), "low_begin", longest - 1, size)
    own = F.least(F.lit(size), F.char_length("said"))
    places = cut.select("conv_id", "piece", F.posexplode(F.transform(
        F.sequence(F.lit(1), own), lambda i: F.substring("said", i, F.lit(look)))).alias("i", "ahead"))
    anchors = places.select("conv_id", "piece", "i", "ahead", F.explode(F.array(*(
        F.when(F.char_length("ahead") >= n, F.left("ahead", F.lit(n))) for n in sizes))).alias("anchor")).where("anchor is not null")
    items = anchored.select("conv_id", "item", F.left("item", F.col("__size")).alias("anchor"))
    found = anchors.join(items, ["conv_id", "anchor"]).where(F.col("ahead").startswith(F.left("item", F.lit(look)))).select(
        "conv_id", "item", "piece", "i")
    if longest > look:
        whole = found.where(F.char_length("item") > look).join(cut, ["conv_id", "piece"]).where(
            F.substring("said", F.col("i") + 1, F.char_length("item")) == F.col("item")).select(*found.columns)
        found = found.where(F.char_length("item") <= look).unionByName(whole)
    return found.select("conv_id", "item", (F.col("piece") * size + F.col("i")).alias("at"))


def verify_turns(outputs: DataFrame, turns: DataFrame, output: str = "output", out: str = "verified",
                 most: int = CONTEXT_CHARS) -> DataFrame:
    """Claims of every output checked against all earlier turns of its conversation, as ``grounding.verify`` does.

    Outputs without an earlier turn are left out; ``context`` is null where it was not put into the row.
    """
    rows, placed = with_earlier(outputs, turns, grounding.items_of(F.col(output)), most)
    if placed is None:
        return grounding.verify(rows.where("context is not null"), output, out=out).drop("known")
    verified = grounding.verify(rows.where("context is not null or known is not null"), output, out=out, known="known")
    near, far = verified.where("known is null"), verified.where("known is not null")
    with_them = far.join(_snippets(far, placed, out), ["conv_id", "turn"], "left")
    filled = F.transform(out, lambda x, i: F.struct(
        x["claim"].alias("claim"), x["is_supported"].alias("is_supported"), x["confidence"].alias("confidence"),
        F.try_element_at("__snippets", i).alias("supporting_context")))
    told = with_them.withColumn(out, filled.cast(grounding.VERIFIED_TYPE)).drop("__snippets")
    return near.drop("known").unionByName(told.drop("known"))


def _snippets(far: DataFrame, placed: DataFrame, verified: str) -> DataFrame:
    """(conv_id, turn, snippets by claim number) of the supported claims of far outputs.

    A claim's words have places in the conversation, places have window numbers; the first window with most words wins.
    """
    # Claims without meaningful words are supported by default and have no snippet.
    claims = far.select("conv_id", "turn", F.posexplode(verified).alias("no", "c")).where("c.is_supported").withColumn(
        "__words", words(F.lower("c.claim"))).where(F.size(grounding.meaningful_words(F.col("c.claim"))) > 0)
    counted = claims.select("conv_id", "turn", "no", F.explode("__words").alias("item")).groupBy(
        "conv_id", "turn", "no", "item").agg(F.count("*").alias("times"))
    lengths = placed.select("conv_id", "turn", (F.col("begin") - 1).alias("chars"), (F.col("low_begin") - 1).alias("low_chars"))
    sized = counted.join(lengths, ["conv_id", "turn"])
    said = placed.join(far.select("conv_id").distinct(), "conv_id", "left_semi").where("text is not null")
    at = occurrences(counted.select("conv_id", "item").distinct(), said)
    length = F.char_length("item")
    inside = sized.join(at, ["conv_id", "item"]).where(F.col("at") + length <= F.col("low_chars")).select(
        "conv_id", "turn", "no", "item", "times", "chars",
        F.explode(grounding.windows_with(F.col("at"), length, grounding.last_window(F.col("chars")))).alias("k"))
    once = inside.groupBy("conv_id", "turn", "no", "chars", "k", "item").agg(F.first("times").alias("times"))
    hits = once.groupBy("conv_id", "turn", "no", "chars", "k").agg(F.sum("times").alias("hits"))
    best = hits.groupBy("conv_id", "turn", "no", "chars").agg(F.max_by("k", F.struct("hits", -F.col("k"))).alias("k"))
    start = F.col("k").cast("bigint") * v.SNIPPET_STEP
    cut = pieces(said, F.col("text"), "begin", v.SNIPPET_CHARS)
    shown = best.withColumn("__start", start).withColumn("piece", _div(F.col("__start"), PIECE_CHARS)).join(cut, ["conv_id", "piece"])
    size = F.least(F.lit(v.SNIPPET_CHARS), F.col("chars") - F.col("__start")).cast("int")
    texts = shown.select("conv_id", "turn", "no", strip(F.substring(
        "said", (F.col("__start") - F.col("piece") * PIECE_CHARS + 1).cast("int"), size)).alias("snippet"))
    return texts.groupBy("conv_id", "turn").agg(F.map_from_entries(F.collect_list(F.struct("no", "snippet"))).alias("__snippets"))
