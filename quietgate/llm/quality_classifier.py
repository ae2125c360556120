"""Quality scores: random-indexing word vectors, pooled per document, and a small calibrated network.

Every word has a random sparse index vector, drawn from its hash; its word vector is the sum of the index vectors of the
words around it over the whole corpus.  Every distinct word has sums of its own, kept in shards by ranges of the hash; they
are whole numbers, so they do not depend on the order in which tasks finish.  A task takes its documents in blocks of
bounded size; a block sends each shard its distinct words once, sorted and packed, and keeps of its texts which of these
words each has and how often, so the texts themselves are not shuffled.  A shard answers with the sums in the order
asked: a frequent word is asked for once by every block, so no shard gets more rows than there are blocks.  A document is the
mean and the spread of its words' vectors, its length and its share of distinct words.  A two-layer network learns from a
bounded sample of labelled documents; a part of the sample kept aside sets the temperature of its probabilities.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from quietgate.llm.blocks import dealt, parts_of
from quietgate.llm.common import Batches, Made, forget_words, give_back, in_slices, record, shared_folder, signed, texts, word_hashes
from quietgate.llm.language_model import _freed, _gaps, _numbered, _numbers, _planes, _range

SIZE = 32             # length of a vector
SIGNS = 4             # entries of an index vector that are not zero
AROUND = 2            # words on either side that count as context
SAMPLE = 8000         # labelled documents that training looks at, about
HIDDEN, STEPS, RATE, DECAY = 32, 500, 0.01, 1e-3
THRESHOLD = 0.7
AT_ONCE = 1 << 16     # words whose context is summed together
_WORD = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\sA-Za-z0-9\x80-\xff]+")
BUFFERED = 6_000_000  # words in a block, which a task holds
SHARD_BYTES = 12 << 20  # of text whose words meet in one shard, about
_DIMS = [f"d{i}" for i in range(SIZE)]
_SUMS = pa.schema([("word", pa.int64()), *((d, pa.int64()) for d in _DIMS)])
_SHARD = pa.schema([("shard", pa.int64()), ("words", pa.binary()), ("sums", pa.binary())])
_SHARD_DDL = "shard bigint, words binary, sums binary"
_BLOCK = pa.schema([("to", pa.int64()), ("block", pa.int64()), ("words", pa.binary()), ("keys", pa.list_(pa.int64())),
                    ("held_out", pa.list_(pa.bool_())), ("sizes", pa.binary()), ("uses", pa.binary())])
_BLOCK_DDL = ("to bigint, block bigint, words binary, keys array<bigint>, held_out array<boolean>, sizes binary, "
              "uses binary")
_KINDS = np.array([4, 10, 40, 255], np.uint64)  # largest sums, doubled, of words packed together
_ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("sums", pa.binary())])
FEATURES = 2 * SIZE + 3
_POOLED = pa.schema([("key", pa.int64()), ("held_out", pa.bool_()), ("x", pa.list_(pa.float32()))])
_SCORED = pa.schema([("key", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])
_FOLD = 1 << 20


def index_vectors(words: np.ndarray = np.arange(64, dtype=np.uint64)) -> np.ndarray:
    """The index vector of every word, drawn from its hash: SIGNS entries of 1 or -1 at different places."""
    x = words.astype(np.uint64)
    places = np.tile(np.arange(SIZE, dtype=np.int8), (len(x), 1))
    out = np.zeros((len(x), SIZE), np.int8)
    row = np.arange(len(x))
    for i in range(SIGNS):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
        high = x >> np.uint64(33)
        at = i + (high % np.uint64(SIZE - i)).astype(np.int64)
        place = places[row, at]
        places[row, at] = places[row, i]
        out[row, place] = 1 - 2 * (x >> np.uint64(32) & np.uint64(1)).astype(np.int8)
    return out


def words_in(text: bytes | None) -> np.ndarray:
    """Hash of every word; runs of other signs are words of their own, case counts."""
    return word_hashes(_WORD.findall(text)) if text else np.empty(0, np.uint64)


def add_contexts(total: np.ndarray, index: np.ndarray, rows: np.ndarray) -> None:
    """Add the index vectors around each word of one text to the word's sums."""
    for at in range(0, len(rows), AT_ONCE):
        lo, hi = max(0, at - AROUND), min(len(rows), at + AT_ONCE + AROUND)
        near = index[rows[lo:hi]]
        sums = np.zeros_like(near)
        for d in range(1, min(AROUND, hi - lo - 1) + 1):
            sums[d:] += near[:-d]
            sums[:-d] += near[d:]
        own = slice(at - lo, min(len(rows), at + AT_ONCE) - lo)
        words, sums = rows[lo:hi][own], sums[own]
        order = np.argsort(words, kind="stable")
        words = words[order]
        starts = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
        total[words[starts]] += np.add.reduceat(sums[order], starts, axis=0, dtype=total.dtype)


def _pack(sums: np.ndarray) -> bytes:
    """Sums of words, those of like size together, dimension by dimension; an even number stands for one not below zero."""
    plain = ((sums.astype(np.int64) << 1) ^ (sums.astype(np.int64) >> 63)).view(np.uint64)
    kind = np.searchsorted(_KINDS, plain.max(1, initial=0)).astype(np.uint64)
    parts = [_planes(kind), *(_planes(plain[kind == k].T.ravel()) for k in np.unique(kind))]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _unpack(data: bytes) -> np.ndarray:
    at, parts = 0, []
    while at < len(data):
        size = int.from_bytes(data[at:at + 8], "little")
        parts.append(_numbers(data[at + 8:at + 8 + size]))
        at += 8 + size
    kind = parts[0]
    plain = np.empty((len(kind), SIZE), np.uint64)
    for k, part in zip(np.unique(kind), parts[1:]):
        plain[kind == k] = part.reshape(SIZE, -1).T
    return (plain >> np.uint64(1)).view(np.int64) ^ -(plain & np.uint64(1)).view(np.int64)


def _buffered(batches: Batches, *names: str):
    """The word hashes of each text of a block of about BUFFERED words, and the texts' other columns."""
    held: list[np.ndarray] = []
    others: list[list] = [[] for _ in names]
    size = 0
    for some in in_slices(batches, forget_words, 64):
        for values, name in zip(others, names):
            values += some.column(name).to_pylist()
        for text in texts(some, "text"):
            held.append(words_in(text))
            size += len(held[-1]) + 1
        if size >= BUFFERED:
            yield held, *others
            held, others, size = [], [[] for _ in names], 0
    if held:
        yield held, *others


def _context_sums(shards: int):
    def run(batches: Batches) -> Made:
        for held, in _buffered(batches):
            lengths, joined = [len(h) for h in held], np.concatenate(held)
            held.clear()
            first, rows = _numbered(joined)
            words, kind = joined[first], np.int32 if len(joined) < 1 << 28 else np.int64
            del joined, first
            at = np.repeat(np.arange(len(lengths), dtype=kind) * kind(AROUND), lengths)
            at += np.arange(len(at), dtype=kind)
            apart = np.full(len(rows) + AROUND * len(lengths), len(words), kind)  # words without a vector between the texts
            apart[at] = rows
            del at, rows
            index = np.concatenate([index_vectors(words), np.zeros((1, SIZE), np.int8)])
            total = np.zeros((len(words) + 1, SIZE), kind)
            add_contexts(total, index, apart)
            for shard, a, b in parts_of(_range(words, 32, shards)):
                yield record(_SHARD, [shard], [_gaps(words[a:b])], [_pack(total[a:b])])
    return run


def _words(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data))


def _added(table: pa.Table) -> pa.Table:
    """One row for all of a shard."""
    asked, sums = table.column("words").to_pylist(), table.column("sums")
    words = np.unique(np.concatenate([_words(a) for a in asked]))
    total = np.zeros((len(words), SIZE), np.int64)
    for a, more in zip(asked, sums):
        total[np.searchsorted(words, _words(a))] += _unpack(more.as_py())
    out = record(_SHARD, [table.column("shard")[0].as_py()], [_gaps(words)], [_pack(total)])
    give_back()
    return pa.Table.from_batches([out])


def _shards(docs: DataFrame, text: str) -> int:
    return max(1, -(-(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // SHARD_BYTES))


def _shard_sums(docs: DataFrame, text: str, shards: int) -> DataFrame:
    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    return rows.mapInArrow(_context_sums(shards), _SHARD_DDL).groupBy("shard").applyInArrow(_added, _SHARD_DDL)


def _listed(batches: Batches) -> Made:
    for batch in batches:
        for row in batch.to_pylist():
            words, sums = _words(row["words"]), _unpack(row["sums"])
            for at in range(0, len(words), AT_ONCE):
                part = sums[at:at + AT_ONCE]
                yield record(_SUMS, signed(words[at:at + AT_ONCE]), *(np.ascontiguousarray(part[:, i]) for i in range(SIZE)))


def word_sums(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, d0, d1, ...): the context sums of every distinct word of the corpus; combined inside each task first."""
    ddl = "word bigint, " + ", ".join(f"{d} bigint" for d in _DIMS)
    return _shard_sums(docs, text, _shards(docs, text)).mapInArrow(_listed, ddl)


def _stored(sums: DataFrame) -> DataFrame:
    """The table in the shared folder; what was shuffled for it may go."""
    spark, schema = sums.sparkSession, sums.schema
    path = f"{shared_folder(spark)}/word-sums-{uuid.uuid4().hex}"
    sums.write.parquet(path)
    del sums
    _freed(spark)
    return spark.read.schema(schema).parquet(path)


def unit(sums: np.ndarray) -> np.ndarray:
    out = sums.astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def pooled(own: np.ndarray, uses: np.ndarray) -> np.ndarray:
    """Features of a text from the unit vectors of its distinct words and how often it has each."""
    out = np.zeros(FEATURES, np.float32)
    if len(uses):
        total = int(uses.sum())
        share = (uses / total).astype(np.float32)
        mean = share @ own
        out[:SIZE] = mean
        out[SIZE:2 * SIZE] = np.sqrt(np.maximum(share @ (own ** 2) - mean ** 2, 0))
        out[2 * SIZE:] = np.log1p(total), len(uses) / total, np.log1p(uses.max()) - np.log1p(total)
    return out


def _asked(shards: int):
    """For each block a row to itself, a number below zero, with its documents, and one to each shard with the words it is asked for."""
    def run(batches: Batches) -> Made:
        block = -1 - (TaskContext.get().partitionId() << 32)
        for held, keys, aside in _buffered(batches, "key", "held_out"):
            for i, own in enumerate(held):
                held[i] = np.unique(own, return_counts=True)
            words = np.unique(np.concatenate([own for own, _ in held]))
            for shard, a, b in parts_of(_range(words, 32, shards)):
                yield record(_BLOCK, [shard], [block], [_gaps(words[a:b])], [None], [None], [None], [None])
            steps = np.concatenate([np.diff(np.searchsorted(words, own), prepend=0) for own, _ in held]).astype(np.uint64)
            yield record(_BLOCK, [block], [block], [_planes(steps)], [keys], [aside],
                         [_planes(np.array([len(own) for own, _ in held], np.uint64))],
                         [_planes(np.concatenate([uses for _, uses in held]).astype(np.uint64))])
            block -= 1
    return run


def _answered(asked: pa.Table, model: pa.Table) -> pa.Table:
    """The sums of a shard's words for each block, in the order asked; a word that the model lacks has none."""
    if not asked.num_rows or (shard := asked.column("to")[0].as_py()) < 0:  # documents of a block
        return _ANSWER.empty_table()
    rows = model.to_pylist()
    known = np.concatenate([np.empty(0, np.uint64), *(_words(r["words"]) for r in rows)])
    sums = np.concatenate([*(_unpack(r["sums"]) for r in rows), np.zeros((1, SIZE), np.int64)])
    out = []
    for block, words in zip(asked.column("block").to_pylist(), asked.column("words").to_pylist()):
        words = _words(words)
        at = np.searchsorted(known, words)
        at[np.append(known, np.uint64(0))[at] != words] = len(known)
        out.append((block, shard, _pack(sums[at])))
    del sums
    give_back()
    return pa.Table.from_batches([record(_ANSWER, *zip(*out))])


def _pooled_block(docs: pa.Table, answers: pa.Table) -> pa.Table:
    if not docs.num_rows or docs.column("to")[0].as_py() >= 0:  # of a shard
        return _POOLED.empty_table()
    parts = answers.sort_by("shard").column("sums")
    vectors = np.concatenate([np.empty((0, SIZE), np.float32), *(unit(_unpack(p.as_py())) for p in parts)])
    found = []
    for row in docs.to_pylist():
        ends = np.cumsum(_numbers(row["sizes"])).astype(np.int64)
        steps, uses = (_numbers(row[c]).astype(np.int64) for c in ("words", "uses"))
        made = [pooled(vectors[np.cumsum(steps[a:b])], uses[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        found.append(record(_POOLED, row["keys"], row["held_out"], made))
    give_back()
    return pa.Table.from_batches(found, _POOLED)


def _pooled_rows(rows: DataFrame, sums: DataFrame, shards: int) -> DataFrame:
    """(key, held_out, x) of rows of key, text and held_out.

    Documents and questions of the blocks share one exchange.  A task that is repeated makes the same blocks, as its rows
    are sorted first.
    """
    ordered = rows.select("key", "held_out", "text").sortWithinPartitions("key", F.xxhash64("text"))
    blocks = dealt(ordered.mapInArrow(_asked(shards), _BLOCK_DDL), "to").groupBy("to")
    answers = blocks.cogroup(sums.groupBy("shard")).applyInArrow(_answered, "block bigint, shard bigint, sums binary")
    return blocks.cogroup(answers.groupBy("block")).applyInArrow(
        _pooled_block, "key bigint, held_out boolean, x array<float>")


@dataclass
class Scorer:
    """Two layers on standardised features, and the temperature of their output."""

    center: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.center) / self.scale @ self.inner + self.inner_bias) @ self.outer + self.outer_bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    @staticmethod
    def constant(p: float) -> Scorer:
        zero = np.zeros(FEATURES)
        return Scorer(zero, zero + 1, np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))


def train(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Scorer:
    """Adam on cross-entropy over four fifths of the rows; the rest sets the temperature.  One class gives a constant."""
    if not len(y):
        return Scorer.constant(0.5)
    if len(np.unique(y)) < 2:
        return Scorer.constant((y.sum() + 0.5) / (len(y) + 1))
    draw = np.random.default_rng(seed)
    aside = draw.random(len(y)) < 0.2
    if len(np.unique(y[~aside])) < 2 or not aside.any():
        aside = np.zeros(len(y), bool)
    a, b = x[~aside].astype(np.float64), y[~aside].astype(np.float64)
    model = Scorer(a.mean(0), a.std(0) + 1e-3, draw.normal(0, FEATURES ** -0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN),
                   draw.normal(0, HIDDEN ** -0.5, HIDDEN), 0.0)
    a = (a - model.center) / model.scale
    outer_bias = np.zeros(1)
    parts = [model.inner, model.inner_bias, model.outer, outer_bias]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, STEPS + 1):
        some = draw.integers(0, len(b), min(len(b), 512))
        h = np.tanh(a[some] @ model.inner + model.inner_bias)
        error = (1 / (1 + np.exp(-np.clip(h @ model.outer + outer_bias, -40, 40))) - b[some]) / len(some)
        dh = error[:, None] * model.outer * (1 - h * h)
        grads = [a[some].T @ dh + DECAY * model.inner, dh.sum(0), h.T @ error + DECAY * model.outer, error.sum(keepdims=True)]
        for p, g, m, v in zip(parts, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    model.outer_bias = float(outer_bias[0])
    if aside.any():
        z, t = model.logits(x[aside]), y[aside]
        tries = np.geomspace(0.25, 8, 41)
        loss = [np.logaddexp(0, np.where(t == 1, -z, z) / k).mean() for k in tries]
        model.temperature = float(tries[int(np.argmin(loss))])
    return model


@dataclass
class Model:
    sums: DataFrame  # of every distinct word, a row for each shard
    shards: int
    scorer: Scorer


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        usable: Column | None = None) -> Model:
    """Word vectors of the whole corpus, and a network from about SAMPLE labelled documents chosen by a hash of the key.

    ``usable`` is a condition on the label table's key.  Where a document is labelled more than once, its mean label
    counts; null keys and labels are left out.
    """
    shards = _shards(docs, text)
    sums = _stored(_shard_sums(docs, text, shards))
    known = F.col(key).isNotNull() & F.col(label).isNotNull()
    rows = labels.where(known if usable is None else known & usable).groupBy(F.col(key).alias("k")).agg(
        (F.avg(label) >= 0.5).cast("int").alias("label"))
    share = min(_FOLD, SAMPLE * _FOLD // max(1, rows.count()) + 1)
    some = rows.where(F.pmod(F.xxhash64("k"), F.lit(_FOLD)) < share)  # about SAMPLE rows of two integers
    texts = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    chosen = texts.join(F.broadcast(some), F.col("key") == F.col("k")).select("key", "text", (F.col("label") == 1).alias("held_out"))
    found = sorted(_pooled_rows(chosen, sums, shards).collect())
    _freed(docs.sparkSession)
    x = np.array([r["x"] for r in found], np.float32).reshape(-1, FEATURES)
    return Model(sums, shards, train(x, np.array([int(r["held_out"]) for r in found])))


def _scored(scorer):
    def run(batches: Batches) -> Made:
        for some in in_slices(batches, forget_words):
            x = np.array(some.column("x").to_pylist(), np.float32).reshape(-1, FEATURES)
            yield record(_SCORED, some.column("key"), some.column("held_out"), scorer.value.scores(x))
    return run


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", held_out: Column | None = None) -> DataFrame:
    """(key, held_out, score) of every row from its whole text alone.

    Null and empty texts are scored like a text without words; repeated rows are scored each; a null key stays null; an
    empty table gives no rows.  Texts of any length are read whole; other columns are not read.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"),
                       (F.lit(False) if held_out is None else held_out).alias("held_out"))
    send = docs.sparkSession.sparkContext.broadcast(model.scorer)
    return _pooled_rows(rows, model.sums, model.shards).mapInArrow(_scored(send), "key bigint, held_out boolean, score double").withColumnRenamed("key", key)
