"""Substring deduplication: passages that occur before are removed, their first occurrence stays.

Every window of a fixed number of words has a Rabin-Karp hash: a polynomial of the words' 64-bit hashes modulo 2^64, taken
for all windows of a block of documents from running sums.  A block asks the shards once for each distinct window hash
it has; a shard counts in which blocks a hash occurs and answers with one bit, whether an earlier block has it.  Blocks
follow the order of the documents, so the rest is known inside the block: of the windows with one hash all but the first
repeat, and the first does if an earlier block has it.  Repeated windows merge into maximal intervals of words.

Equal windows are told by 64-bit hashes.  No text or position leaves its block, and what is sent grows with the distinct
windows of a block, however often they occur.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quietgate.llm.blocks import asked, dealt, in_blocks, in_order, messages, pack_sorted, parts_of, unpack_sorted
from quietgate.llm.common import forget_words, word_hashes

WINDOW = 20            # words
SHARD_BYTES = 16 << 20  # text whose windows one shard takes, about 3 million
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_INTERVALS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``size`` items, mixed so that its leading bits spread evenly."""
    if len(hashes) < size:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _powers(pow(_BASE, -1, 1 << 64), len(hashes)), out=sums[1:])
    out = (sums[size:] - sums[:-size]) * _powers(_BASE, len(hashes))[size - 1:]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


class _Block:
    """Words and distinct window hashes of a block's documents, in order."""

    def __init__(self, table: pa.Table, window: int):
        keys, texts = table.column("key").to_pylist(), table.column("text").cast(pa.binary()).to_pylist()
        order = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i] or 0, texts[i] or b""))
        self.keys = [keys[i] for i in order]
        self.words = [(texts[i] or b"").split() for i in order]
        self.ends = np.cumsum([len(w) for w in self.words], dtype=np.int64)
        hashes = np.concatenate([word_hashes(w) for w in self.words])
        rolled = rolling(hashes, window)
        # Windows that run over the end of their document are none.
        document_end = np.repeat(self.ends, [len(w) for w in self.words])[:len(rolled)]
        self.starts = np.flatnonzero(np.arange(len(rolled)) + window <= document_end)
        self.distinct, self.first = np.unique(rolled[self.starts], return_index=True)
        forget_words()

    def repeated(self, earlier: np.ndarray, window: int) -> np.ndarray:
        """Which words a repeated window covers; ``earlier`` tells of each distinct one whether an earlier block has it."""
        again = np.ones(len(self.starts), bool)
        again[self.first] = earlier
        change = np.zeros(int(self.ends[-1]) + 1, np.int32)
        change[self.starts[again]] += 1
        change[self.starts[again] + window] -= 1
        return np.cumsum(change[:-1]) > 0


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _asking(window: int, shards: int):
    def run(table: pa.Table) -> pa.Table:
        block = int(table.column("block")[0].as_py())
        keys = _Block(table, window).distinct
        return messages([(block, s, pack_sorted(keys[a:b])) for s, a, b in parts_of(_shard_of(keys, shards))])
    return run


def _answer(table: pa.Table) -> pa.Table:
    """For every hash of every block one bit: whether a block before has it."""
    rows = in_order(table, "origin")
    keys = [unpack_sorted(body) for _, _, body in rows]
    before = np.ones(sum(map(len, keys)), bool)
    before[np.unique(np.concatenate(keys), return_index=True)[1]] = False
    ends = np.cumsum([len(k) for k in keys])
    return messages([(b, s, np.packbits(before[end - len(k):end]).tobytes()) for (b, s, _), k, end in zip(rows, keys, ends)])


def _intervals(block: _Block, removed: np.ndarray) -> pa.Array:
    """Maximal runs of removed words of every document, counted from its first word."""
    begins = np.zeros(len(removed) + 1, bool)
    begins[np.concatenate([[0], block.ends])] = True
    opens = removed & (begins[:-1] | ~np.concatenate([[False], removed[:-1]]))
    closes = removed & (begins[1:] | ~np.concatenate([removed[1:], [False]]))
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    offsets = np.concatenate([[0], np.searchsorted(first, block.ends)]).astype(np.int32)
    origin = np.repeat(np.concatenate([[0], block.ends[:-1]]), np.diff(offsets))
    pairs = pa.StructArray.from_arrays([pa.array(first - origin), pa.array(last + 1 - origin)], ["start", "stop"])
    return pa.ListArray.from_arrays(pa.array(offsets), pairs)


def _finishing(window: int, shards: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(table, window)
        bits = {s: body for _, s, body in in_order(answers, "shard")}
        earlier = [np.unpackbits(np.frombuffer(bits[s], np.uint8), count=b - a).astype(bool)
                   for s, a, b in parts_of(_shard_of(block.distinct, shards))]
        removed = block.repeated(np.concatenate(earlier) if earlier else np.empty(0, bool), window)
        intervals = _intervals(block, removed)
        kept, lost, at = [], [], 0
        for words in block.words:
            gone = removed[at:at + len(words)]
            lost.append(int(gone.sum()))
            kept.append(b" ".join(compress(words, (~gone).tolist()) if lost[-1] else words))
            at += len(words)
        return pa.table({
            "key": pa.array(block.keys, pa.int64()), "n_words": pa.array(map(len, block.words), pa.int64()),
            "n_removed": pa.array(lost, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            "removed": intervals.cast(_INTERVALS)})
    return run


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_removed, kept, removed) of every row: the words that stay, and the intervals of words that go.

    A word goes if a window of ``window`` words over it also starts earlier, at a smaller key or further ahead in the
    same text; windows are judged on the input.  ``kept`` joins the words that stay by one space, ``removed`` holds
    (start, stop) in words.  Null and empty texts have no words and keep an empty text; texts shorter than a window lose
    nothing; texts of any length are taken whole.  Keys are whole numbers; a null key stays null and comes first.  Rows
    with equal keys are documents of their own, ordered by a hash or their text; of equal rows the first keeps its
    words.  An empty table gives no rows.  Other columns are not read.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    rows, total = in_blocks(docs, key, text)
    shards = max(1, -(-total // SHARD_BYTES))
    made = asked(dealt(rows, "block"), "block", _asking(window, shards), _answer, _finishing(window, shards),
                 "key bigint, n_words bigint, n_removed bigint, kept string, removed array<struct<start:bigint,stop:bigint>>")
    return made.withColumnRenamed("key", key)


def digest(deduped: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and the hash of what is kept."""
    return deduped.select(key, "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
