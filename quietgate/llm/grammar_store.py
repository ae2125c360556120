"""Token ids as grammar-compressed shards: Re-Pair per shard, read back whole or at any place.

A shard is one row of a Parquet file: the documents it holds, the sequence of ids left after compression, the rules
(nonterminal ``base + i`` stands for the pair ``rules[i]``) and the length each rule expands to.  As the lengths are
stored, the place of any token in the sequence is found by a running sum, and only what covers it is expanded.

Pairs are replaced in rounds: the most frequent pairs of a round get a nonterminal each and are replaced together, from
left to right where they overlap, until no pair is left that pays for a rule.  One pair at a time would need a pass over the shard for each of thousands of rules.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quietgate.llm.common import Batches, Made, in_slices, record, small
from quietgate.llm.tokens import Coder

SHARD_TOKENS = 1 << 20
RULES_A_ROUND = 2048
LEAST_USES = 4  # a rule takes 12 bytes and each use saves 4
END_ID = 1

_SHARD = pa.schema([
    ("part", pa.int32()), ("shard", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ("n_tokens", pa.int64()), ("base", pa.int32()), ("rules", pa.binary()), ("expansions", pa.binary()), ("sequence", pa.binary())])
_SHARD_DDL = ("part int, shard int, doc_ids array<bigint>, lengths array<bigint>, n_tokens bigint, base int, rules binary, "
              "expansions binary, sequence binary")
_DOC = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("doc_id", pa.int64()), ("within", pa.int64()), ("n_tokens", pa.int64())])
_DOC_DDL = "part int, shard int, doc_id bigint, within bigint, n_tokens bigint"


@dataclass
class Grammar:
    base: int
    rules: np.ndarray       # (n, 2) of uint32
    expansions: np.ndarray  # tokens each rule stands for
    sequence: np.ndarray    # uint32


def _frequent(keys: np.ndarray) -> np.ndarray:
    """The most frequent pairs, sorted."""
    ordered = np.sort(keys)
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    uses = np.diff(np.append(starts, len(ordered)))
    often = np.flatnonzero(uses >= LEAST_USES)
    if len(often) > RULES_A_ROUND:
        often = often[np.argsort(-uses[often], kind="stable")[:RULES_A_ROUND]]
    return np.sort(ordered[starts[often]])


def _found(keys: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of chosen pairs without overlaps, and which pair each is."""
    spread = lambda k: (k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)
    maybe = np.zeros(1 << 18, bool)
    maybe[spread(chosen)] = True
    at = np.flatnonzero(maybe[spread(keys)])
    which = np.searchsorted(chosen, keys[at])
    which[which == len(chosen)] = 0
    right = chosen[which] == keys[at]
    at, which = at[right], which[right]
    if not len(at):
        return at, which
    run_start = np.maximum.accumulate(np.where(np.concatenate(([True], np.diff(at) > 1)), np.arange(len(at)), 0))
    kept = (np.arange(len(at)) - run_start) % 2 == 0
    return at[kept], which[kept]


def compress(ids: np.ndarray, base: int) -> Grammar:
    """Grammar of a sequence of ids below ``base``; an empty sequence has no rules."""
    x = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    made = 0
    while len(x) > 1:  # every round shortens the sequence
        keys = (x[:-1].astype(np.uint64) << np.uint64(32)) | x[1:]
        chosen = _frequent(keys)
        if not len(chosen):
            break
        at, which = _found(keys, chosen)
        x[at] = base + made + which
        keep = np.ones(len(x), bool)
        keep[at + 1] = False
        x = x[keep]
        rules.append(np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        made += len(chosen)
    pairs = np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)
    lengths = np.ones(base + made, np.int64)
    done = base
    for block in rules:  # a round's rules refer to earlier rounds only
        lengths[done:done + len(block)] = lengths[block[:, 0]] + lengths[block[:, 1]]
        done += len(block)
    return Grammar(base, pairs, lengths[base:].astype(np.uint32), x)


def expand(grammar: Grammar, start: int = 0, length: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``start + length``; only the symbols that cover them are expanded."""
    base = grammar.base
    symbols = grammar.sequence
    sizes = np.ones(len(symbols), np.int64)
    derived = symbols >= base
    sizes[derived] = grammar.expansions[symbols[derived] - base]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    stop = total if length is None else min(total, start + length)
    if start >= stop:
        return np.empty(0, np.uint32)
    first, last = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left")
    x, skipped = symbols[first:last + 1], int(ends[first] - sizes[first])
    while (derived := x >= base).any():  # each pass replaces every nonterminal by its pair: as many as there are rounds
        width = np.where(derived, 2, 1)
        begins = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.uint32)
        out[begins[~derived]] = x[~derived]
        pairs = grammar.rules[x[derived] - base]
        out[begins[derived]], out[begins[derived] + 1] = pairs[:, 0], pairs[:, 1]
        x = out
    return x[start - skipped:stop - skipped]


def _encoded(path: str, end_id: int, base: int, shard_tokens: int):
    def run(batches: Batches) -> Made:
        part, shard = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        held: list[bytes] = []
        size = 0
        end = np.array([end_id], "<u4").tobytes()

        def row():
            g = compress(np.frombuffer(b"".join(held), "<u4"), base)
            return record(_SHARD, [part], [shard], [keys], [[len(h) // 4 for h in held]], [size], [base],
                          [g.rules.tobytes()], [g.expansions.tobytes()], [g.sequence.tobytes()])

        coder = Coder.of(path)
        for some in in_slices(batches, coder.forget):
            for key, ids in zip(some.column("doc_id").to_pylist(), coder.encode(some.column("text").to_pylist())):
                if ids and np.frombuffer(ids, "<u4").max() >= base:
                    raise ValueError(f"a token id is not below base, {base}")
                keys.append(key)
                held.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= shard_tokens:
                    yield row()
                    keys, held, size, shard = [], [], 0, shard + 1
        if keys:
            yield row()
    return run


def write(docs: DataFrame, folder: str, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID,
          base: int = 1 << 16, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the ids of all documents in ascending key order as shards of about ``shard_tokens`` ids.

    Null and empty texts are the end id alone; rows with a null key come first; rows with the same key keep their own
    entries, in the order of a hash of their texts.  Texts of any length are encoded whole; an empty table gives no
    shards; other columns are not read.  ``base`` is any number above all token ids.  The key order comes from a range partitioning, each part is
    encoded on its own, and a part's shards hold at most one document more than ``shard_tokens`` ids.
    """
    if end_id >= base:
        raise ValueError("base must be above the end id")
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    # Equal keys are ordered by a hash of their texts, so that rows without a key, or under one, are in several parts.
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    ordered.mapInArrow(_encoded(vocabulary, end_id, base, shard_tokens), _SHARD_DDL).write.parquet(folder)


def grammar_of(row: dict) -> Grammar:
    return Grammar(row["base"], np.frombuffer(row["rules"], np.uint32).reshape(-1, 2),
                   np.frombuffer(row["expansions"], np.uint32), np.frombuffer(row["sequence"], np.uint32))


def _read(made):
    """Documents of each shard; ``made`` turns the bytes of a document's ids into the last column."""
    schema, of_ids = made

    def run(batches: Batches) -> Made:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = memoryview(expand(grammar_of(row)).astype("<u4").tobytes())
                lengths = np.array(row["lengths"], np.int64)
                within = np.cumsum(lengths) - lengths
                last = [of_ids(ids[4 * w:4 * (w + n)]) for w, n in zip(within.tolist(), lengths.tolist())]
                n = len(last)
                yield record(schema, np.full(n, row["part"], np.int32), np.full(n, row["shard"], np.int32), row["doc_ids"],
                             within, lengths, last)
    return run


def shards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_SHARD_DDL).parquet(folder)


def read(spark: SparkSession, folder: str, checksums: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ``start`` counts the ids of all documents before it.

    With ``checksums``, ``ids_crc32`` (of the little-endian ids) comes instead of the ids, worked out where they are
    expanded.  Running sums over shards need two levels: over the parts (as many as the writer had tasks), and within
    each part.
    """
    index = shards(spark, folder).select("part", "shard", F.col("n_tokens").alias("t"))
    parts = index.groupBy("part").agg(F.sum("t").alias("p")).select(
        "part", (F.sum("p").over(Window.orderBy("part")) - F.col("p")).alias("before"))
    inside = F.sum("t").over(Window.partitionBy("part").orderBy("shard")) - F.col("t")
    offsets = index.join(parts, "part").select("part", "shard", (F.col("before") + inside).alias("offset"))
    side = F.broadcast(offsets) if small(index, 100_000) else offsets
    name, kind, ddl, of_ids = ("ids_crc32", pa.int64(), "bigint", zlib.crc32) if checksums else ("ids", pa.binary(), "binary", bytes)
    docs = shards(spark, folder).mapInArrow(_read((_DOC.append(pa.field(name, kind)), of_ids)), f"{_DOC_DDL}, {name} {ddl}")
    return docs.join(side, ["part", "shard"]).select("doc_id", (F.col("offset") + F.col("within")).alias("start"), "n_tokens", name)


def token_range(spark: SparkSession, folder: str, part: int, shard: int, start: int, length: int) -> np.ndarray:
    """Some ids of one shard, without expanding the rest of it."""
    row = shards(spark, folder).where((F.col("part") == part) & (F.col("shard") == shard)).first()
    return expand(grammar_of(row.asDict()), start, length) if row else np.empty(0, np.uint32)
