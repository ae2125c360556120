"""Benchmark decontamination: item-sized windows, SimHash, multi-index Hamming search, exact check.

Built-in functions only.  Documents and items become runs of hashed five-word shingles.  A window with a weighted
similarity of at least the threshold to an item shares one of the item's rarest shingles, as many of them as weigh more
than what such a window may lack (a prefix filter).  Only where a document has one of these is a window cut: as long as
the item, placed so that the shared shingle lies where the item has it.

Each distinct window gets a 64-bit SimHash, its shingles weighted by rarity.  Fingerprints are cut into five blocks; two
that differ in at most RADIUS bits have a block that differs in at most three.  The items are indexed under every block
value within two bits, the windows look up every value within one bit, so no pair within the radius is missed.
Candidates are then compared exactly, as weighted multisets of shingles.

The benchmark is a query set: it is broadcast in blocks of a fixed number of index rows, however many items it has.
Windows that many documents share are fingerprinted and compared once.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, functions as F

from quietgate.llm.common import cut, small

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 19
BLOCK_BITS = (13, 13, 13, 13, 12)
SEED_ROWS = 200_000  # rows of the item index that are sent to every executor at once
MATCH_ROWS = 200_000


def _masks(bits: int, most: int) -> list[int]:
    """All values with at most ``most`` of ``bits`` bits set."""
    return [sum(1 << i for i in some) for k in range(most + 1) for some in itertools.combinations(range(bits), k)]


def _held(value: Column) -> Column:
    """Behind a one-element explode an array is computed once, whatever uses it."""
    return F.explode_outer(F.array(value))


def _shingled(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, grams): the hashed shingles of every text in order; letters and digits are words, case is ignored."""
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    hashed = df.select(F.col(key).alias("key"), _held(words).alias("words")).select(
        "key", _held(F.transform("words", lambda w: F.xxhash64(w))).alias("h"))
    count = F.size("h") - (SHINGLE - 1)
    runs = F.transform(F.slice("h", 1, F.greatest(count, F.lit(0))), lambda x, i: F.xxhash64(
        x, *(F.get(F.col("h"), i + j) for j in range(1, SHINGLE))))
    return hashed.select("key", _held(runs).alias("grams"))


class _Benchmark:
    """Items, the weight of each of their shingles, and the seeds that lead to windows."""

    def __init__(self, items: DataFrame, key: str, text: str):
        self.items = cut(_shingled(items, key, text).where("size(grams) > 0").withColumnRenamed("key", "own")
                         .dropDuplicates(["own", "grams"]).withColumn("key", F.monotonically_increasing_id())
                         .withColumn("size", F.size("grams")))  # a number for every item, as ids may repeat or be null
        total = self.items.count()
        placed = self.items.select("key", "size", F.posexplode("grams").alias("at", "gram"))
        uses = placed.groupBy("gram").agg(F.count_distinct("key").alias("uses"))
        self.weights = uses.select("gram", F.log1p(F.lit(float(total)) / F.col("uses")).alias("weight"))
        self.unseen = math.log1p(total)
        held = placed.join(self.weights, "gram")
        self.counts = cut(held.groupBy("key", "gram").agg(F.count("*").alias("n"), F.first("weight").alias("weight")))
        # Rarest first; the rest may weigh at most a fifth of the item.
        listed = held.groupBy("key", "size").agg(F.sort_array(F.collect_list(F.struct("weight", "at", "gram")), False).alias("s"), F.sum("weight").alias("w"))
        sums = F.aggregate("s", F.struct(F.lit(0.0).alias("w"), F.array().cast("array<boolean>").alias("on")), lambda a, s: F.struct(
            (a["w"] + s["weight"]).alias("w"), F.array_append(a["on"], a["w"] <= F.lit(1 - THRESHOLD + 1e-9) * F.col("w")).alias("on")))["on"]
        kept = listed.withColumn("on", sums).select("size", F.explode(F.filter("s", lambda x, i: F.get(F.col("on"), i))).alias("x"))
        self.seeds = cut(kept.select("x.gram", "x.at", "size").distinct())


def _fingerprints(contents: DataFrame, weights: DataFrame, unseen: float, key: str) -> DataFrame:
    """(key, fp): sign of the weighted sum of each bit over all shingles."""
    rows = contents.select(key, F.explode("grams").alias("gram")).join(weights, "gram", "left")
    weight = F.coalesce("weight", F.lit(unseen))
    sums = rows.groupBy(key).agg(*(F.sum(F.when(F.getbit("gram", F.lit(i)) == 1, weight).otherwise(-weight)).alias(f"b{i}") for i in range(64)))
    bits = F.lit(0).cast("bigint")
    for i in range(64):
        bits = bits.bitwiseOR(F.when(F.col(f"b{i}") > 0, F.shiftleft(F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return sums.select(key, bits.alias("fp"))


def _near_values(block: int, shift: int, bits: int, most: int) -> Column:
    """(block, value) for every value within ``most`` bits of a fingerprint's block."""
    own = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    masks = F.array(*(F.lit(m).cast("bigint") for m in _masks(bits, most)))
    return F.transform(masks, lambda m: F.struct(F.lit(block).alias("block"), own.bitwiseXOR(m).alias("value")))


def _looked_up(prints: DataFrame, most: int) -> DataFrame:
    """Every block value within ``most`` bits of a fingerprint's own."""
    shifts = [sum(BLOCK_BITS[:b]) for b in range(len(BLOCK_BITS))]
    blocks = [_near_values(b, shift, bits, most) for b, (shift, bits) in enumerate(zip(shifts, BLOCK_BITS))]
    return prints.select("*", F.explode(F.flatten(F.array(*blocks))).alias("k")).select("*", "k.block", "k.value").drop("k")


def _windows(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(key, start, size, wid, grams) of every window; a document shorter than the item is one window."""
    found = docs.select("key", "grams", F.posexplode("grams").alias("pos", "gram")).join(F.broadcast(seeds), "gram")
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("at"), F.size("grams") - F.col("size")))
    cut_out = found.select("key", start.alias("start"), "size", F.slice("grams", start + 1, F.col("size")).alias("grams"))
    return cut_out.withColumn("wid", F.xxhash64("grams", "size")).dropDuplicates(["key", "start", "size", "wid"])


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
            item_text: str = "text") -> DataFrame:
    """(key, item_key, start, n_words, similarity): the most similar window of every document and item at 0.8 or more.

    ``start`` counts the document's words (runs of letters and digits).  Items of fewer than five words have no shingle
    and match nothing, and so do null and empty texts; documents with a null key are reported as one.
    Every text of a repeated or null item key is searched; the most similar of them is reported under that key, of
    equally similar windows the first.  Repeated rows are reported once; a benchmark or a table without rows gives none.
    Texts of any length are searched whole, and only the key and text columns are read.
    """
    bench = _Benchmark(items, item_key, item_text)
    rows = _shingled(docs, key, text)
    n = bench.seeds.count()
    parts = max(1, -(-n // SEED_ROWS))
    windows = None
    for i in range(parts):
        block = bench.seeds.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == i)
        found = _windows(rows, block)
        windows = found if windows is None else windows.unionByName(found)
    windows = cut(windows)
    contents = cut(windows.select("wid", "size", "grams").dropDuplicates(["wid"]))
    weights = bench.weights
    ours = _looked_up(_fingerprints(contents, weights, bench.unseen, "wid").join(contents.select("wid", "size"), "wid"), 1)
    theirs = _looked_up(_fingerprints(bench.items, weights, bench.unseen, "key").join(bench.items.select("key", "size"), "key"), 2)
    near = F.bit_count(F.col("o.fp").bitwiseXOR(F.col("t.fp"))) <= RADIUS
    met = ours.alias("o").join(theirs.alias("t"), (F.col("o.block") == F.col("t.block")) & (F.col("o.value") == F.col("t.value"))
                               & (F.col("o.size") == F.col("t.size")) & near)
    pairs = met.select("o.wid", F.col("t.key").alias("item")).distinct()
    ours_n = contents.select("wid", F.explode("grams").alias("gram")).groupBy("wid", "gram").agg(F.count("*").alias("n")).join(
        weights, "gram", "left").withColumn("weight", F.coalesce("weight", F.lit(bench.unseen)))
    total = ours_n.groupBy("wid").agg(F.sum(F.col("n") * F.col("weight")).alias("w"))
    item_total = bench.counts.groupBy("key").agg(F.sum(F.col("n") * F.col("weight")).alias("iw")).withColumnRenamed("key", "item")
    both = pairs.join(ours_n.select("wid", "gram", "n"), "wid").join(
        bench.counts.select(F.col("key").alias("item"), "gram", F.col("n").alias("m"), "weight"), ["item", "gram"])
    shared = both.groupBy("wid", "item").agg(F.sum(F.least("n", "m") * F.col("weight")).alias("common"))
    alike = F.col("common") / (F.col("w") + F.col("iw") - F.col("common"))
    verified = cut(shared.join(total, "wid").join(item_total, "item").select("wid", "item", alike.alias("similarity")).where(
        F.col("similarity") >= THRESHOLD - 1e-9))
    side = F.broadcast(verified) if small(verified, MATCH_ROWS) else verified
    best = windows.select("key", "start", F.size("grams").alias("n"), "wid").join(side, "wid").join(
        bench.items.select(F.col("key").alias("item"), "own"), "item").groupBy("key", "own").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("start"), "n")).alias("b"))
    return best.select(F.col("key").alias(key), F.col("own").alias(item_key), (-F.col("b.start")).alias("start"),
                       (F.col("b.n") + SHINGLE - 1).alias("n_words"), "b.similarity")


def decontaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The table without documents that hold an item; rows with a null key stay, columns are unchanged."""
    hit = cut(matches(docs, items, key, text).where(F.col(key).isNotNull()).select(F.col(key).alias("__hit")).distinct())
    side = F.broadcast(hit) if small(hit, MATCH_ROWS) else hit
    return docs.join(side, docs[key] == side["__hit"], "left_anti")
