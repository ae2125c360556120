"""N-gram Jaccard join: near copies by rare-first prefix filtering, as components of linked documents.

A document is its set of distinct word n-grams.  Documents with the same set form a class; classes, not documents, are
joined.  Blocks of documents ask shards of the n-grams how many classes have each of theirs, exactly.  The n-grams of a
set are ordered by that number, rarest first; two sets that reach the threshold share one of their first
``n - ceil(t * n) + 1``.  Of these only the n-grams that several classes have become rows.  Pairs that meet there pass a
length filter, a positional filter and a suffix filter (a 512-bit parity sketch: the bits in which two sketches differ
are a lower bound of the n-grams in which the sets differ) before the sets themselves are compared, once per pair.

Links are only needed up to connectivity, so the members of a prefix n-gram are not paired with each other outright.
First every member meets its neighbours in a shuffled order of the n-gram's members (linear in their number); what that
connects is contracted, and n-grams with so few members that all of them have met are done.  Then only members of
different components meet, the smaller components against the rest, which is dealt to parts.  All pairs not yet connected
are tested in that step, so no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quietgate.llm.blocks import BLOCK_BYTES, ROW_BYTES, asked, dealt, in_order, messages, pack_sorted, parts_of, unpack_sorted
from quietgate.llm.common import Batches, Made, compact, cut, forget_words, give_back, in_slices, record, shingles, signed, small, texts, words_of
from quietgate.llm.components import components

SHARD_BYTES = 16 << 20  # text whose n-grams one shard counts
SKETCH = [f"s{i}" for i in range(8)]
BROADCAST_ROWS = 2_000_000  # rows of two integers at most, about 50 MB, are sent to every executor
MEMBERS = 4096  # of one n-gram that are ordered in one task
NEIGHBOURS = 3  # that a member of a rare n-gram meets: all pairs of up to four
ORDERS = 4      # shuffled orders of a turn that frequent n-grams share, so that the same pairs come up again
_SIGNED = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), *((s, pa.int64()) for s in SKETCH)])
_PREFIX = pa.schema([("gram", pa.int64()), ("sig", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
_SETS = pa.schema([("sig", pa.int64()), ("grams", pa.list_(pa.int64()))])


def signature(grams: np.ndarray) -> int:
    return np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes(), len(grams))).astype(np.int64).item()


def _sketch(grams: np.ndarray) -> np.ndarray:
    odd = np.bincount((grams >> np.uint64(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signed_rows(size: int):
    def run(batches: Batches) -> Made:
        for batch in in_slices(batches, forget_words):
            n, sigs, sketches = [], [], []
            for text in texts(batch, "text"):
                grams = shingles(words_of(text), size)
                n.append(len(grams))
                sigs.append(signature(grams) if len(grams) else None)
                sketches.append(_sketch(grams))
            bits = np.array(sketches, np.int64).reshape(-1, 8)
            yield record(_SIGNED, batch.column("key"), n, sigs, *(bits[:, i] for i in range(8)))
    return run


def _shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    return ((grams >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


class _Sets:
    """The n-gram sets of the classes whose owners are in a block: rows with a signature name owners, the others are documents."""

    def __init__(self, table: pa.Table, size: int):
        keys, sigs = table.column("key").to_pylist(), table.column("sig").to_pylist()
        owners = {(k, s) for k, s in zip(keys, sigs) if s is not None}
        self.sigs, self.sets = [], []
        for key, sig, text in zip(keys, sigs, table.column("text").cast(pa.binary()).to_pylist()):
            if sig is not None or not text:
                continue
            found = shingles(words_of(text), size)
            if len(found) and (own := (key, signature(found))) in owners:
                owners.discard(own)  # a repeated row is the same class
                self.sigs.append(own[1])
                self.sets.append(found)
        forget_words()
        self.distinct, self.times = np.unique(np.concatenate([np.empty(0, np.uint64), *self.sets]), return_counts=True)


def _numbers(values: np.ndarray) -> bytes:
    """Small whole numbers, most of them one."""
    raw = values.astype(np.int32).tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True)


def _of_numbers(body: bytes, count: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(body, 4 * count, codec="zstd", asbytes=True), np.int32)


def _asking(size: int, shards: int):
    """Every distinct n-gram of a block with the number of its classes there."""
    def run(table: pa.Table) -> pa.Table:
        block, sets = int(table.column("block")[0].as_py()), _Sets(table, size)
        return messages([(block, s, len(packed).to_bytes(8, "little") + packed + _numbers(sets.times[x:y]))
                         for s, x, y in parts_of(_shard_of(sets.distinct, shards)) for packed in [pack_sorted(sets.distinct[x:y])]])
    return run


def _answer(table: pa.Table) -> pa.Table:
    """The number of classes in the whole corpus for every n-gram of every block."""
    rows = in_order(table, "origin")
    keys, times = [], []
    for _, _, body in rows:
        end = 8 + int.from_bytes(body[:8], "little")
        keys.append(unpack_sorted(body[8:end]))
        times.append(_of_numbers(body[end:], len(keys[-1])))
    _, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(which, np.concatenate(times)).astype(np.int64)[which]
    ends = np.cumsum([len(k) for k in keys])
    return messages([(b, s, _numbers(total[end - len(k):end])) for (b, s, _), k, end in zip(rows, keys, ends)])


def _prefixes(size: int, shards: int, num: int, den: int):
    """Prefix rows of the n-grams that more than one class has."""
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        sets = _Sets(table, size)
        bodies = {s: body for _, s, body in in_order(answers, "shard")}
        classes = np.concatenate([np.empty(0, np.int32), *(
            _of_numbers(bodies[s], y - x) for s, x, y in parts_of(_shard_of(sets.distinct, shards)))])
        grams, sigs, sizes, places = [], [], [], []
        for sig, found in zip(sets.sigs, sets.sets):
            n = len(found)
            keep = n + (-num * n // den) + 1
            of = classes[np.searchsorted(sets.distinct, found)]
            order = np.argsort(of, kind="stable")[:keep]
            shared = np.flatnonzero(of[order] > 1).astype(np.int32)
            grams.append(found[order[shared]])
            sigs.append(np.full(len(shared), sig))
            sizes.append(np.full(len(shared), n, np.int32))
            places.append(shared)
        join = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts])
        made = record(_PREFIX, signed(join(grams, np.uint64)), join(sigs, np.int64), join(sizes, np.int32), join(places, np.int32))
        del sets, classes, grams
        give_back()
        return pa.Table.from_batches([made])
    return run


def _set_rows(size: int):
    def run(batches: Batches) -> Made:
        for batch in in_slices(batches, forget_words):
            sets = [shingles(words_of(t), size) for t in texts(batch, "text")]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = signed(np.concatenate(sets)) if sets else np.empty(0, np.int64)
            yield record(_SETS, [signature(s) if len(s) else None for s in sets],
                         pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)).cast(_SETS.field("grams").type))
    return run


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "bigint", pa.int32(): "int"}
    return ", ".join(f"{f.name} {kinds.get(f.type, 'array<bigint>')}" for f in schema)


class _Join:
    """One run of the join: the inputs, what is known of the classes, and the pairs tested so far."""

    def __init__(self, docs: DataFrame, key: str, text: str, size: int, num: int, den: int):
        self.spark: SparkSession = docs.sparkSession
        self.size, self.num, self.den = size, num, den
        self.docs = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
        self.signed = cut(self.docs.mapInArrow(_signed_rows(size), _ddl(_SIGNED)))
        self.classes = cut(self.signed.where("sig is not null and key is not null").groupBy("sig").agg(
            F.min("key").alias("key"), F.first("n").cast("int").alias("n"), *(F.first(s).alias(s) for s in SKETCH)))
        self.tested: DataFrame | None = None
        self.links: DataFrame | None = None

    def _needed(self, n1: Column, n2: Column) -> Column:
        """Least overlap of two sets that reach the threshold."""
        return F.ceil(F.lit(self.num) * (n1 + n2) / F.lit(float(self.num + self.den)) - F.lit(1e-9))

    def _may_reach(self, p: str, q: str) -> Column:
        """Length filter, then the positional filter: what is left behind the shared n-gram bounds the overlap."""
        a, b = (lambda c: F.col(f"{p}.{c}")), (lambda c: F.col(f"{q}.{c}"))
        longest, shortest = F.greatest(a("n"), b("n")), F.least(a("n"), b("n"))
        rest = F.least(a("n") - a("pos"), b("n") - b("pos"))
        return (shortest * F.lit(self.den) >= longest * F.lit(self.num)) & (rest >= self._needed(a("n"), b("n")))

    def _sketches_allow(self, n1: Column, n2: Column, pairs: list[tuple[Column, Column]]) -> Column:
        apart = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in pairs), F.lit(0))
        return apart <= n1 + n2 - 2 * self._needed(n1, n2)

    def _owned(self) -> tuple[DataFrame, int]:
        """Documents and the owners of the classes, in blocks by key, and the bytes of all texts; a hot key's rows are dealt on."""
        size = F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES
        docs = self.docs.where("key is not null").select("key", "text", F.lit(None).cast("bigint").alias("sig"))
        total = docs.agg(F.sum(size)).first()[0] or 0
        blocks = max(1, -(-total // BLOCK_BYTES))
        # Fewer rows than half the blocks.
        hot = cut(docs.groupBy("key").agg(F.sum(size).alias("bytes")).where(F.col("bytes") > 2 * BLOCK_BYTES).select(
            "key", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int").alias("parts")))
        owners = self.classes.select("key", F.lit(None).cast("string").alias("text"), "sig")
        if hot.isEmpty():
            both = docs.unionByName(owners).withColumn("part", F.lit(0))
        else:
            parts = F.coalesce("parts", F.lit(1))
            dealt_out = docs.join(F.broadcast(hot), "key", "left").withColumn("part", F.pmod(F.xxhash64("text"), parts).cast("int"))
            everywhere = owners.join(F.broadcast(hot), "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
            both = dealt_out.unionByName(everywhere).drop("parts")
        return both.withColumn("block", F.pmod(F.xxhash64("key", "part"), F.lit(blocks)).cast("int")).drop("part"), total

    def members(self) -> DataFrame:
        """Prefix rows of the n-grams that more than one class has in its prefix."""
        rows, total = self._owned()
        shards = max(1, -(-total // SHARD_BYTES))
        prefix = compact(cut(asked(dealt(rows, "block"), "block", _asking(self.size, shards), _answer,
                           _prefixes(self.size, shards, self.num, self.den), _ddl(_PREFIX))))
        shared = prefix.groupBy("gram").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi"), F.count("*").alias("rows")).where(
            "lo <> hi").select("gram", "rows")
        return compact(cut(prefix.join(shared, "gram").groupBy("gram", "sig").agg(
            F.first("n").alias("n"), F.min("pos").alias("pos"), F.max("rows").alias("rows"))))

    def verify(self, pairs: DataFrame) -> None:
        """Compare the sets of new pairs (a, b) and keep those that reach the threshold as links."""
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = compact(cut(pairs))
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        if pairs.isEmpty():
            found = pairs
        else:
            involved = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
            keys = compact(cut(self.classes.join(involved, "sig", "left_semi").select("key")))
            side = F.broadcast(keys) if small(keys, BROADCAST_ROWS) else keys
            # A repeated key may bring a set twice or bring another one: no harm, as the links are made distinct.
            sets = self.docs.join(side, "key", "left_semi").mapInArrow(_set_rows(self.size), _ddl(_SETS)).where("sig is not null")
            both = pairs.join(sets.select(F.col("sig").alias("a"), F.col("grams").alias("x")), "a").join(
                sets.select(F.col("sig").alias("b"), F.col("grams").alias("y")), "b")
            common = F.size(F.array_intersect("x", "y"))
            found = compact(cut(both.select("a", "b", common.alias("i"), (F.size("x") + F.size("y")).alias("t")).where(
                F.lit(self.den) * F.col("i") >= F.lit(self.num) * (F.col("t") - F.col("i"))).select("a", "b").distinct()))
        self.links = found if self.links is None else self.links.unionByName(found)

    def labelled(self, rows: DataFrame) -> DataFrame:
        known = components(self.links)
        return rows.join(known.withColumnRenamed("node", "sig"), "sig", "left").withColumn(
            "component", F.coalesce("component", "sig"))

    def neighbours(self, rows: DataFrame, turn: int) -> DataFrame:
        """Pairs of members that follow each other in a shuffled order of an n-gram's members.

        The members of a frequent n-gram are dealt to groups of about MEMBERS, other ones in every order and turn.
        """
        order_of = F.pmod("gram", F.lit(ORDERS))
        mixed = F.xxhash64("sig", order_of, F.lit(turn))
        group = F.pmod(F.xxhash64(mixed), F.ceil(F.col("rows") / MEMBERS))
        order = Window.partitionBy("gram", "group").orderBy("mixed", "sig")
        this = F.struct("sig", "n", "pos", "component")
        near = rows.withColumns({"mixed": mixed, "group": group}).select(
            "gram", "rows", this.alias("p"), *(F.lag(this, i).over(order).alias(f"q{i}") for i in range(1, NEIGHBOURS + 1)))
        few = F.col("rows") <= NEIGHBOURS + 1
        met = F.array("q1", *(F.when(few, F.col(f"q{i}")) for i in range(2, NEIGHBOURS + 1)))
        found = near.select("p", F.explode(met).alias("q")).where(
            F.col("q").isNotNull() & (F.col("p.component") != F.col("q.component")) & self._may_reach("p", "q"))
        return self.sketched(found.select(F.least("p.sig", "q.sig").alias("a"), F.greatest("p.sig", "q.sig").alias("b")).distinct())

    def sketched(self, pairs: DataFrame) -> DataFrame:
        side = lambda name: self.classes.select(F.col("sig").alias(name), F.struct("n", *SKETCH).alias(f"{name}_"))
        allow = self._sketches_allow(F.col("a_.n"), F.col("b_.n"), [(F.col(f"a_.{s}"), F.col(f"b_.{s}")) for s in SKETCH])
        return pairs.join(side("a"), "a").join(side("b"), "b").where(allow).select("a", "b")

    def across(self, rows: DataFrame) -> DataFrame:
        """All pairs of an n-gram's members in different components: its smaller components against all members.

        A frequent n-gram's members are dealt to parts, and the members of its smaller components come to every part.
        """
        sizes = rows.groupBy("gram", "component").agg(F.count("*").alias("c"))
        mixed = sizes.groupBy("gram").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("k"))
        parts = F.ceil(F.col("rows") / MEMBERS).cast("int")
        open_ = cut(rows.join(mixed.where("k > 1").drop("k"), "gram").join(self.classes.select("sig", *SKETCH), "sig").withColumn(
            "parts", parts))
        few = open_.where("component <> main").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("p")
        all_ = open_.withColumn("part", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int")).alias("q")
        once = (F.col("q.component") == F.col("q.main")) | (F.col("p.sig") < F.col("q.sig"))
        allow = self._sketches_allow(F.col("p.n"), F.col("q.n"), [(F.col(f"p.{s}"), F.col(f"q.{s}")) for s in SKETCH])
        met = few.join(all_, (F.col("p.gram") == F.col("q.gram")) & (F.col("p.part") == F.col("q.part"))
                       & (F.col("p.component") != F.col("q.component")) & once & self._may_reach("p", "q") & allow)
        return met.select(F.least("p.sig", "q.sig").alias("a"), F.greatest("p.sig", "q.sig").alias("b")).distinct()

    def every_pair(self) -> DataFrame:
        """All pairs of an n-gram's members.  A frequent one's members are dealt to parts; every two parts meet in a task of their own."""
        parts = F.ceil(F.col("rows") / MEMBERS).cast("int")
        dealt = self.members().join(self.classes.select("sig", *SKETCH), "sig").withColumn("parts", parts).withColumn(
            "part", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int"))
        cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns(
            {"i": F.least("part", "other"), "j": F.greatest("part", "other")})
        own = (F.col("p.part") != F.col("q.part")) | (F.col("p.i") == F.col("p.j"))
        allow = self._sketches_allow(F.col("p.n"), F.col("q.n"), [(F.col(f"p.{s}"), F.col(f"q.{s}")) for s in SKETCH])
        met = cells.alias("p").join(cells.alias("q"), (F.col("p.gram") == F.col("q.gram")) & (F.col("p.i") == F.col("q.i")) & (
            F.col("p.j") == F.col("q.j")) & (F.col("p.sig") < F.col("q.sig")) & own & self._may_reach("p", "q") & allow)
        return met.select(F.col("p.sig").alias("a"), F.col("q.sig").alias("b")).distinct()

    def run(self, turns: int) -> DataFrame:
        members = self.members()
        rows = members.withColumn("component", F.col("sig"))
        for turn in range(turns):
            self.verify(self.neighbours(rows, turn))
            if turn == 0:
                members = compact(cut(members.where(F.col("rows") > NEIGHBOURS + 1)))  # the pairs of the others have all met
            rows = compact(cut(self.labelled(members)))
        self.verify(self.across(rows))
        return components(self.links)


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, numerator: int = 80,
                     denominator: int = 100, turns: int = 2) -> DataFrame:
    """Near copies: (key, n_shingles, component_id) of every row.

    Two documents link when ``denominator * |A and B| >= numerator * |A or B|`` for their sets of distinct ``size``-word
    n-grams of whole, A-Z-lower-cased texts.  ``component_id`` is the smallest key reachable by links.  A shorter text is
    one n-gram; null texts and texts without words have none and link with nothing; rows without a key link with
    nothing and have a null component.  Repeated rows are copies of each other.  Texts of any length are compared whole;
    an empty table gives no rows.  Other columns are not looked at.
    """
    join = _Join(docs, key, text, size, numerator, denominator)
    found = join.run(turns).withColumnRenamed("node", "sig")
    least = join.classes.select("sig", "key").join(found, "sig").groupBy("component").agg(F.min("key").alias("least"))
    moved = found.join(least, "component").select("sig", "least")
    of_class = join.classes.select("sig", F.col("key").alias("own")).join(moved, "sig", "left").select(
        "sig", F.coalesce("least", "own").alias("component_id"))
    rows = join.signed.select(F.col("key"), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.col("sig")).alias("sig"))
    return rows.join(of_class, "sig", "left").select(
        F.col("key").alias(key), "n_shingles", F.coalesce("component_id", "key").alias("component_id"))


def ngram_links(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, numerator: int = 80,
                denominator: int = 100) -> tuple[DataFrame, DataFrame]:
    """All links: (a, b) of every two classes that link, each by its smallest key, and (key, class, n_shingles, n_links) of every row.

    Links are those of ``ngram_components``, also inside groups that are connected without them.  Rows of the same set
    are one class and link with each other; ``n_links`` counts the other rows that a row links with.  Rows without a key
    have neither class nor number; rows without words are no class and have no links.
    """
    join = _Join(docs, key, text, size, numerator, denominator)
    join.verify(join.every_pair())
    weights = join.signed.where("sig is not null and key is not null").groupBy("sig").agg(F.count("*").alias("w"))
    both = join.links.unionByName(join.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    outside = both.join(weights, both["b"] == weights["sig"]).groupBy("a").agg(F.sum("w").alias("o")).withColumnRenamed("a", "sig")
    of_class = cut(join.classes.select("sig", F.col("key").alias("class")).join(weights, "sig").join(outside, "sig", "left").select(
        "sig", "class", (F.col("w") - 1 + F.coalesce("o", F.lit(0))).alias("links")))
    name = lambda end: of_class.select(F.col("sig").alias(end), F.col("class").alias(f"{end}_"))
    pairs = join.links.join(name("a"), "a").join(name("b"), "b").select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b"))
    rows = join.signed.select("key", F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.col("sig")).alias("sig"))
    return pairs, rows.join(of_class, "sig", "left").select(
        F.col("key").alias(key), "class", "n_shingles", F.when(F.col("key").isNotNull(), F.coalesce("links", F.lit(0))).alias("n_links"))
