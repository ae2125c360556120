"""Language-model scores: a smoothed trigram or bigram model as a weighted automaton with failure arcs.

States are the pairs of words seen as history (order 3), the words seen as history, the document's start, and a root.
A state has an arc for every n-gram that continues it, however rare; all other words take its failure arc, weighted with
what the state leaves over: from a pair (u, v) to v, from a word to the root, which has an arc for every word.

Order 3 takes an absolute discount D off every count, D = n1 / (n1 + 2 n2) from the n-grams of each order that the corpus
has once and twice; T counts the different words that follow a history:

    P(w | u, v) = (max(c(u, v, w) - D, 0) + D * T(u, v) * P(w | v)) / c(u, v)    or P(w | v) if the pair is no history
    P(w | v)    = (max(c(v, w) - D, 0) + D * T(v) * P(w)) / c(v)                 or P(w) if v is no history

Order 2 is a plain mixture:

    P(w | h) = share * c(h, w) / c(h) + (1 - share * kept(h) / c(h)) * P(w)

where kept(h) counts the occurrences of h's bigrams that were seen LEAST times.  P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),
one unseen word having the mass of an unknown one.  The weights of a state sum to one.

The model grows with the corpus, so no task holds all of it.  Documents are dealt to blocks of bounded size.  Tasks count
the distinct n-grams of the blocks they see, words and bigrams in one pass over the texts and trigrams in another, and
send them, sorted and packed, to shards by ranges of words and of histories.  A shard adds them up and answers every block with totals alone, in the order of the block's
own n-grams.  A block finds its n-grams again in its texts, puts the totals beside them and scores its documents.
"""

from __future__ import annotations

import gc
import math
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quietgate.llm.common import Batches, Made, cut, give_back, in_slices, record, shared_folder

LEAST = 1               # occurrences in training that retain an n-gram: all
SHARE = 0.6             # of a history's mass that its retained bigrams may take in a model of order 2
DISCOUNT = 0.75         # where no n-gram was seen once, or none twice
BLOCK_BYTES = 32 << 20  # of text that two tasks score, whose arrays take many times that
SHARD_BYTES = 12 << 20  # of text whose n-grams meet in one shard, about
BUFFERED = 4_000_000    # tokens that a counting task holds
AT_ONCE = 500_000       # tokens scored together, about
END, START = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"\n</s>", b"\n<s>"))  # no word has a line feed
_KEPT = -1              # block of the rows that tell a shard of words what their histories keep
_PACK = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("part", pa.int64()), ("a", pa.binary()), ("r", pa.binary()),
                   ("b", pa.binary()), ("n", pa.binary())])
_PACK_DDL = "shard bigint, block bigint, part bigint, a binary, r binary, b binary, n binary"
_SCORES = pa.schema([("key", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("base_score", pa.float64()), ("score", pa.float64())])


def _freed(spark: SparkSession) -> None:
    """Spark removes shuffle files once the driver has collected the objects that stand for them, which it is asked to do.

    Objects of the write that has just ended may still be held, so this is called before the next one.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _stored(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here.

    The counts that were shuffled for it are not needed again.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark)}/language-model-{uuid.uuid4().hex}"
    _freed(spark)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the start, the words and the end of every text, one text after the other, and how many each has."""
    texts = texts.cast(pa.large_string()).take(np.arange(len(texts)))  # a copy of its own: ascii_lower misreads slices
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))  # x20 and x09-x0D
    sizes, flat = pc.list_value_length(words).to_numpy(zero_copy_only=False), words.flatten()
    kept = pc.greater(pc.binary_length(flat), 0)
    sums = np.concatenate(([0], np.cumsum(kept.to_numpy(zero_copy_only=False))))
    edges = np.concatenate(([0], np.cumsum(sizes)))
    sizes, found = np.diff(sums[edges]), flat.filter(kept).dictionary_encode()
    distinct = found.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    ends = np.cumsum(sizes + 2)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    word = np.ones(len(out), bool)
    word[ends - 1] = word[ends - sizes - 2] = False
    out[ends - 1], out[ends - sizes - 2] = END, START
    out[word] = hashes[found.indices.to_numpy()]
    return out, sizes + 2


def _pair(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """56 bits for a bigram: from the history's hash and 40 bits of the word's."""
    x = (history ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(31)
    x = (x + word) * np.uint64(0x9FB21C651E98DF25)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(8)


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of their bytes, of as many as the largest needs."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _numbers(data: bytes) -> np.ndarray:
    width, items = data[0], int.from_bytes(data[1:9], "little")
    out = np.zeros((items, 8), np.uint8)
    if items:
        plain = pa.decompress(data[9:], items * width, codec="zstd", asbytes=True)
        out[:, :width] = np.frombuffer(plain, np.uint8).reshape(width, items).T
    return out.view("<u8").ravel()


def _joined(parts: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *parts])


def _gaps(ordered: np.ndarray) -> bytes:
    return _planes(np.diff(ordered, prepend=ordered.dtype.type(0)))


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Whether each of some sorted items is the first of its value."""
    out = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=out[1:])
    return out


def _packed(high: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Distinct pairs in order with their counts: distinct histories, how many words each has, and the steps between those."""
    new = _starts(high)
    steps = np.diff(low, prepend=low.dtype.type(0))
    steps[new] = low[new]
    at = np.flatnonzero(new)
    return _gaps(high[at]), _planes(np.diff(at, append=len(high))), _planes(steps), _planes(n)


def _unpacked(row: dict) -> tuple[np.ndarray, ...]:
    """The distinct histories, how many words each has, the words, and the counts."""
    runs, low = _numbers(row["r"]).astype(np.int64), np.cumsum(_numbers(row["b"]))
    at = np.cumsum(runs) - runs
    before = np.where(at > 0, low[at - 1], np.uint64(0))
    return np.cumsum(_numbers(row["a"])), runs, low - np.repeat(before, runs), _numbers(row["n"]).astype(np.int64)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each distinct key in sorted order, and the number each key has in that order."""
    order = np.argsort(keys)
    new = _starts(keys[order])
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return order[new], number


def _numbered_pairs(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for pairs of a small number and one of 40 bits."""
    if int(high.max(initial=0)) < 1 << 24:
        return _numbered((high.astype(np.uint64) << np.uint64(40)) | low)
    order = np.lexsort((low, high))
    new = _starts(high[order]) | _starts(low[order])
    number = np.empty(len(high), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return order[new], number


def _range(keys: np.ndarray, shift: int, parts: int) -> np.ndarray:
    """Number of the equal range that holds each key, by the 32 bits above ``shift``."""
    return (((keys >> np.uint64(shift)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


class Grams:
    """Distinct words, bigrams and trigrams of texts, each in its order, and the number that each token's has there.

    ``kinds`` has (shard, history, word) of those asked for: a word is its own history, a bigram's history is a word, a
    trigram's the number of its first two words.  Words are told by their hash, those after a word by 40 bits of it, after two by 32.
    """

    def __init__(self, hashes: np.ndarray, shards: int, sizes: tuple[int, ...]):
        self.kinds = {}
        after = hashes >> np.uint64(24)
        inside = hashes[1:] != START  # no n-gram crosses from one document into the next
        if 2 in sizes:
            first, self.word = _numbered(hashes)
            self.words = words = hashes[first]
            history, low = self.word[:-1][inside], after[1:][inside]
            first, number = _numbered_pairs(history, low)
            history, low = words[history[first]], low[first]
            self.pair = np.full(len(inside), -1, np.int32)
            self.pair[inside] = number
            # histories by ranges; with many shards, each history's words are dealt to several of them
            parts = 1 + math.isqrt(shards) // 8
            rows = max(1, shards // parts)
            self.kinds[1] = _range(words, 32, shards), words, words
            self.kinds[2] = shards + _range(history, 32, rows) * parts + (low % np.uint64(parts)).astype(np.int64), history, low
        if 3 in sizes:
            whole = inside[:-1] & inside[1:]
            numbers = _pair(history, low) if 2 in sizes else _pair(hashes[:-2], after[1:-1])[whole]
            first, rank = _numbered(numbers)
            numbers = numbers[first]
            high, low = rank[self.pair[:-1][whole]] if 2 in sizes else rank, (hashes[2:] >> np.uint64(32))[whole]
            first, number = _numbered_pairs(high, low)
            self.triple = np.full(len(whole), -1, np.int32)
            self.triple[whole] = number
            ranks = high[first]
            history, low = numbers[ranks], low[first]
            place = np.zeros(len(numbers), np.int32)  # among the histories of trigrams; a bigram that ends a document is none
            place[ranks] = np.cumsum(_starts(ranks), dtype=np.int32) - np.int32(1)
            self.history = place[rank]  # of each distinct bigram
            self.kinds[3] = 2 * shards + _range(history, 24, 2 * shards), history, low  # there are more of them


def _by_shard(shard: np.ndarray):
    """An order by shard that keeps the order inside each, and (shard, first, stop) there."""
    order = np.argsort(shard, kind="stable")
    at = np.flatnonzero(_starts(shard[order]))
    return order, [(int(shard[order[a]]), a, b) for a, b in zip(at, np.append(at[1:], len(shard)))]


def _counting(shards: int, sizes: tuple[int, ...]):
    """The distinct n-grams of some sizes of the blocks that a task sees, with their uses in training, for the shards."""
    def rows_of(block: int, hashes: np.ndarray, trained: np.ndarray):
        grams = Grams(hashes, shards, sizes)
        for size in sizes:
            number = grams.triple if size == 3 else grams.pair if size == 2 else grams.word
            shard, history, word = grams.kinds[size]
            real = number >= 0
            n = np.bincount(number[real], trained[size - 1:][real], len(shard)).astype(np.uint64)
            by, runs = _by_shard(shard)
            history, word, n = history[by], word[by], n[by]
            for at, lo, hi in runs:
                if size == 1:
                    yield at, block, at, _gaps(word[lo:hi]), b"", b"", _planes(n[lo:hi])
                else:
                    yield at, block, at, *_packed(history[lo:hi], word[lo:hi], n[lo:hi])

    def run(batches: Batches) -> Made:
        held: dict[int, list] = defaultdict(list)
        size = 0

        def flush():
            for block in list(held):
                parts = held.pop(block)
                found = rows_of(block, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                if columns := list(zip(*found)):
                    yield record(_PACK, *columns)

        for batch in in_slices(batches, give_back):
            made, sizes = tokens(batch.column("text"))
            trained = np.repeat(~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool), sizes)
            blocks = np.repeat(batch.column("block").to_numpy(), sizes)
            for block in np.unique(blocks).tolist():
                own = blocks == block
                held[block].append((made[own], trained[own]))
            size += len(made)
            if size >= BUFFERED:
                yield from flush()
                size = 0
        yield from flush()
    return run


def _merged(shards: int, order: int):
    """Totals of a shard's bigrams or trigrams for each block, in the order of the block's own; words pass.

    A trigram shard also tells a block how many words follow each of its histories.  A bigram shard tells the words' shards
    what each history has of retained bigrams: their occurrences in a model of order 2, their number in one of order 3.
    Two more rows of each have the numbers of n-grams seen once and twice as their block.
    """
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        shard = rows[0]["shard"]
        if shard < shards:
            return table
        triples = shard >= 2 * shards
        found = [_unpacked(r) for r in rows]
        first, history = _numbered(np.concatenate([f[0] for f in found]))
        known = np.concatenate([f[0] for f in found])[first]
        high = np.repeat(history, np.concatenate([f[1] for f in found]))
        first, number = _numbered_pairs(high, np.concatenate([f[2] for f in found]))
        n = np.bincount(number, np.concatenate([f[3] for f in found]), len(first)).astype(np.int64)
        high = high[first]
        retained = n >= LEAST
        follow = np.bincount(high[retained], n[retained] if order == 2 else None, len(known)).astype(np.int64)
        kind = -5 if triples else -1
        out = [(kind - 1, int((n == 1).sum()), 0, b"", b"", b"", b""), (kind - 2, int((n == 2).sum()), 0, b"", b"", b"", b"")]
        asked = defaultdict(list)
        for r, f, a, b in zip(rows, found, np.split(history, np.cumsum([len(f[0]) for f in found])[:-1]),
                              np.split(number, np.cumsum([len(f[2]) for f in found])[:-1])):
            asked[r["block"]].append((a, b))
        for block, parts in asked.items():
            own = parts[0][1] if len(parts) == 1 else np.unique(np.concatenate([p[1] for p in parts]))
            after = b""
            if triples:
                after = _planes(follow[parts[0][0] if len(parts) == 1 else np.unique(np.concatenate([p[0] for p in parts]))])
            out.append((kind, block, shard, b"", b"", after, _planes(n[own])))
        if not triples:
            some = follow > 0
            known, follow = known[some], follow[some]
            by, runs = _by_shard(_range(known, 32, shards))
            out += [(at, _KEPT, 0, _gaps(known[lo:hi]), b"", b"", _planes(follow[lo:hi])) for at, lo, hi in runs]
        del found
        give_back()
        return pa.Table.from_batches([record(_PACK, *zip(*out))])
    return run


def _merged_words(table: pa.Table) -> pa.Table:
    """Totals of a shard's words and what they keep as histories, for each block; two rows have N and V as their block."""
    rows = table.to_pylist()
    ours, kept = [r for r in rows if r["block"] != _KEPT], [r for r in rows if r["block"] == _KEPT]
    words = [np.cumsum(_numbers(r["a"])) for r in ours]
    first, number = _numbered(_joined(words))
    known = _joined(words)[first]
    n = np.bincount(number, _joined([_numbers(r["n"]) for r in ours]), len(known)).astype(np.int64)
    mass = np.zeros(len(known), np.int64)
    for r in kept:
        mass[np.searchsorted(known, np.cumsum(_numbers(r["a"])))] += _numbers(r["n"]).astype(np.int64)
    asked = defaultdict(list)
    for r, own in zip(ours, np.split(number, np.cumsum([len(w) for w in words])[:-1])):
        asked[r["block"]].append(own)
    out = []
    for block, parts in asked.items():
        own = np.unique(np.concatenate(parts))
        out.append((-2, block, ours[0]["shard"], b"", b"", _planes(mass[own]), _planes(n[own])))
    real = n[(known != START) & (n > 0)]
    out += [(-3, int(real.sum()), 0, b"", b"", b"", b""), (-4, len(real), 0, b"", b"", b"", b"")]
    return pa.Table.from_batches([record(_PACK, *zip(*out))])


class Automaton:
    """A block's part of the model: what its own states and arcs were seen."""

    def __init__(self, rows: list[dict], grams: Grams, total: int, distinct: int, share: float = SHARE,
                 discounts: tuple[float, float] | None = None):
        self.grams, self.share, self.discounts = grams, share, discounts

        def answered(kind: int, at: int, column: str = "n") -> np.ndarray:
            """A column of the answers, for the n-grams in their order; a place more, where -1 points, has none."""
            parts = sorted((r["part"], r[column]) for r in rows if r["shard"] == kind)
            out = np.zeros(len(grams.kinds[at][0]) + 1, np.int64)
            out[_by_shard(grams.kinds[at][0])[0]] = _joined([_numbers(n) for _, n in parts])
            return out

        self.counts, self.kept = answered(-2, 1), answered(-2, 1, "b")
        self.known = (self.counts + 0.1) / (total + 0.1 * (distinct + 1))
        self.pairs = answered(-1, 2)
        if discounts is not None:
            self.triples = answered(-5, 3)
            parts = sorted((r["part"], r["b"]) for r in rows if r["shard"] == -5)
            self.follow = _joined([*(_numbers(n) for _, n in parts), np.zeros(1, np.uint64)]).astype(np.int64)

    def scores(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the tokens after ``lo`` and before ``hi``: whether known, log10 probability by the words alone and by the automaton.

        Every state's arc or failure arcs, one order after the other.
        """
        word, pair = self.grams.word[lo:hi], self.grams.pair[lo:hi - 1]
        uses, follow, seen = self.counts[word[:-1]], self.kept[word[:-1]], self.pairs[pair]
        base = self.known[word[1:]]
        arcs = np.where(seen >= LEAST, seen, 0)
        if self.discounts is None:
            made = (1 - self.share * follow / np.maximum(uses, 1)) * base + self.share * arcs / np.maximum(uses, 1)
            return self.counts[word[1:]] > 0, np.log10(base), np.log10(made, out=np.zeros_like(made), where=pair >= 0)
        made = self._discounted(arcs, uses, follow, base, self.discounts[0])
        if hi - lo > 2:
            triple = self.grams.triple[lo:hi - 2]
            longer = self._discounted(self.triples[triple], seen[:-1], self.follow[self.grams.history[pair[:-1]]], made[1:], self.discounts[1])
            made[1:] = np.where(triple < 0, made[1:], longer)
        return self.counts[word[1:]] > 0, np.log10(base), np.log10(made)

    @staticmethod
    def _discounted(seen, uses, follow, below, discount):
        held = np.maximum(seen - discount, 0) + discount * follow * below
        return np.where((uses > 0) & (follow > 0), held / np.maximum(uses, 1), below)


def _scoring(total: int, distinct: int, shards: int, order: int, discounts: tuple[float, float] | None):
    def run(docs: pa.Table, model: pa.Table) -> pa.Table:
        made, sizes = zip(*(tokens(b.column("text")) for b in docs.to_batches(max_chunksize=512))) if docs.num_rows else ((), ())
        hashes, sizes = _joined(list(made)), _joined(list(sizes), np.int64)
        del made
        if not len(sizes):
            return _SCORES.empty_table()
        automaton = Automaton(model.to_pylist(), Grams(hashes, shards, (1, 2, 3)[:order]), total, distinct, discounts=discounts)
        del hashes
        ends = np.cumsum(sizes)
        out = []
        at = 0
        while at < len(sizes):  # whole documents
            lo = int(ends[at] - sizes[at])
            stop = max(at + 1, int(np.searchsorted(ends, lo + AT_ONCE, "right")))
            starts, last = ends[at:stop] - sizes[at:stop] - lo, ends[at:stop] - 1 - lo
            found = []
            for values in automaton.scores(lo, int(ends[stop - 1])):
                values = np.append(values, 0)
                values[last] = 0  # what comes after an end is another document
                found.append(np.add.reduceat(values, starts))
            out.append(found)
            at = stop
        known, base, score = (np.concatenate(x) for x in zip(*out))
        del automaton
        give_back()
        docs = docs.combine_chunks()
        return pa.table([docs.column("key"), docs.column("held_out"), pa.array(sizes - 1), pa.array(known.astype(np.int64)),
                         pa.array(base), pa.array(score)], schema=_SCORES)
    return run


def _blocks(rows: DataFrame, block_bytes: int | None = None) -> tuple[DataFrame, int]:
    """Deal documents to blocks of about ``block_bytes`` (BLOCK_BYTES) by ranges of their key, and the bytes of all texts.

    Ranges that hold more are dealt on by a hash.
    """
    block_bytes = block_bytes or BLOCK_BYTES
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 32
    lo, hi, total = rows.agg(F.min("key"), F.max("key"), F.sum(size)).first()
    count = max(1, -(-(total or 0) // block_bytes))
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) // count))
    dealt = rows.withColumn("range", F.coalesce(F.floor((F.col("key") - F.lit(lo or 0)) / F.lit(width)), F.lit(0)))
    large = cut(dealt.groupBy("range").agg(F.sum(size).alias("bytes")).where(F.col("bytes") > 2 * block_bytes).select(
        "range", F.ceil(F.col("bytes") / block_bytes).alias("parts")))  # half as many rows as blocks at most
    part = F.lit(0).cast("bigint")
    if not large.isEmpty():
        dealt = dealt.join(F.broadcast(large), "range", "left")
        part = F.pmod(F.xxhash64("key", "text"), F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("block", (F.col("range") * F.lit(1 << 20) + part).cast("bigint"))
    return dealt.select("key", "text", "held_out", "block"), total or 0


def _sums(rows: DataFrame, *kinds: int) -> list[int]:
    return [x or 0 for x in rows.agg(*(F.sum(F.when(F.col("shard") == k, F.col("block"))) for k in kinds)).first()]


def _discount(counted: DataFrame, *kinds: int) -> float:
    once, twice = _sums(counted, *kinds)
    return once / (once + 2 * twice) if once and twice else DISCOUNT


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out: Column | None = None, order: int = 2) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``order`` is 2 or 3.  The model learns from the rows that are not held out.  Tokens are the whole text's words, A-Z lowered, and one end;
    null and empty texts are the end alone.  Repeated rows count and are scored each; a null key stays null; an empty
    table gives no rows.  Texts of any length are counted and scored whole; other columns are not read.
    """
    aside = F.lit(False) if held_out is None else held_out
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), aside.alias("held_out"))
    rows, size = _blocks(rows, BLOCK_BYTES // 2)
    shards = max(1, -(-size // SHARD_BYTES))

    def merged(*sizes: int) -> DataFrame:
        grams = rows.select("block", "held_out", "text").mapInArrow(_counting(shards, sizes), _PACK_DDL)
        return _stored(grams.groupBy("shard").applyInArrow(_merged(shards, order), _PACK_DDL))

    pairs = merged(1, 2)
    words = _stored(pairs.where("shard >= 0").groupBy("shard").applyInArrow(_merged_words, _PACK_DDL))
    total, distinct = _sums(words, -3, -4)
    model = pairs.where("shard = -1").unionByName(words.where("shard = -2"))
    discounts = None
    if order == 3:  # on their own, so that no more than one of the shuffles is on disk
        triples = merged(3)
        discounts = _discount(pairs, -2, -3), _discount(triples, -6, -7)
        model = model.unionByName(triples.where("shard = -5"))
    _freed(docs.sparkSession)
    made = rows.groupBy("block").cogroup(model.groupBy("block")).applyInArrow(
        _scoring(total, distinct, shards, order, discounts), "key bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return made.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"),
                       "base_score", "score")
