"""Hierarchical packing of token ids into sequences of several context sizes.

Whole windows of the longest size are cut off a document first.  What is left of it is routed to the smallest tier that
holds it.  Tiers are packed from the longest: a window starts with a piece of its own tier, and its gap is filled with
the longest pieces of shorter tiers that fit; where none fits, a short piece is cut and its rest routed anew.  So every
window is full, and windows of the shorter sizes take only what longer windows had no gap for.

Each task packs its own rows, with no shuffle.  What remains at the end of a task is less than one window; it is cut at
powers of two, so nothing is padded.  Sequences of one tier are dealt to step groups of the same number of tokens.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quietgate.llm.common import Batches, Made, in_slices, record
from quietgate.llm.tokens import Coder

TIERS = (1024, 512, 256, 128)
STEP_TOKENS = 8192
END_ID = 0
_PLACE = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("tier", pa.int32()),
    ("step_group", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_PLACE_DDL = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, tier int, step_group bigint, sequence_id bigint, offset bigint"
Piece = tuple  # (doc_id, start, doc_tokens, ids)


class Packer:
    """Packs the documents of one task; ``rows`` are the finished pieces."""

    def __init__(self, task: int, tiers: tuple[int, ...], step_tokens: int):
        self.task, self.tiers, self.step_tokens = task, tiers, step_tokens
        self.pools = {t: deque() for t in tiers}
        self.held = dict.fromkeys(tiers, 0)  # tokens in each pool
        self.sequences, self.of_tier = 0, {}
        self.rows: list[tuple] = []

    def _put(self, piece: Piece, front: bool = False) -> None:
        n = len(piece[3]) // 4
        tier = min(t for t in self.tiers if n <= t)
        (self.pools[tier].appendleft if front else self.pools[tier].append)(piece)
        self.held[tier] += n

    def _take(self, tier: int, most: int) -> Piece:
        """The next piece of a tier, cut to ``most`` tokens; its rest goes back."""
        doc, start, total, ids = self.pools[tier].popleft()
        n = len(ids) // 4
        self.held[tier] -= n
        if n > most:
            self._put((doc, start + most, total, ids[4 * most:]), front=True)
            ids = ids[:4 * most]
        return doc, start, total, ids

    def _finish(self, pieces: list[Piece], size: int) -> None:
        count = self.of_tier[size] = self.of_tier.get(size, -1) + 1
        group = (self.task << 40) + (count * size // self.step_tokens << 12) + size
        sequence, offset = (self.task << 40) + self.sequences, 0
        self.sequences += 1
        for doc, start, total, ids in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, total, size, group, sequence, offset, ids))
            offset += n

    def add(self, doc: int | None, ids: bytes) -> None:
        total, longest = len(ids) // 4, self.tiers[0]
        whole = total - total % longest
        for start in range(0, whole, longest):
            self._finish([(doc, start, total, ids[4 * start:4 * (start + longest)])], longest)
        if whole < total:
            self._put((doc, whole, total, ids[4 * whole:]))

    def _fill(self, size: int, first: int) -> None:
        """One window of ``size`` tokens, begun with a piece of tier ``first``."""
        pieces, gap = [], size
        tier = first
        while gap:
            piece = self._take(tier, gap)
            pieces.append(piece)
            gap -= len(piece[3]) // 4
            filled = [t for t in self.tiers if self.pools[t]]
            if not gap or not filled:
                break
            fitting = [t for t in filled if t <= gap]
            tier = fitting[0] if fitting else filled[-1]
        self._finish(pieces, size - gap)

    def pack(self) -> None:
        """Close all windows that the pieces at hand can fill."""
        for i, size in enumerate(self.tiers):
            while self.pools[size] and sum(self.held[t] for t in self.tiers[i:]) >= size:
                self._fill(size, size)

    def flush(self) -> None:
        """Close what is left: whole windows first, then windows of the powers of two that add up to the rest."""
        self.pack()
        while left := sum(self.held.values()):
            size = min(self.tiers[0], 1 << (left.bit_length() - 1))
            self._fill(size, next(t for t in self.tiers if self.pools[t]))


def _packed(path: str, end_id: int, tiers: tuple[int, ...], step_tokens: int, checksums: bool):
    schema = _PLACE.append(pa.field("ids_crc32", pa.int64()) if checksums else pa.field("ids", pa.binary()))

    def run(batches: Batches) -> Made:
        packer = Packer(TaskContext.get().partitionId(), tiers, step_tokens)
        end = np.array([end_id], "<u4").tobytes()

        def rows():
            *places, ids = zip(*packer.rows)
            packer.rows = []
            return record(schema, *places, list(map(zlib.crc32, ids)) if checksums else ids)

        coder = Coder.of(path)
        for some in in_slices(batches, coder.forget):
            for key, ids in zip(some.column("doc_id").to_pylist(), coder.encode(some.column("text").to_pylist())):
                packer.add(key, ids + end)
            packer.pack()
            if packer.rows:
                yield rows()
        packer.flush()
        if packer.rows:
            yield rows()
    return run


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID,
         tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, checksums: bool = False) -> DataFrame:
    """Pieces of all documents, placed in sequences: (doc_id, start, length, doc_tokens, tier, step_group, sequence_id, offset, ids).

    ``tiers`` are powers of two from the longest to the shortest.  A document's ids are followed by ``end_id``; null and
    empty texts are ``end_id`` alone; a null key stays null; repeated rows are packed each.  ``tier`` is the sequence's
    length.  Every id lies in exactly one piece.  With ``checksums``, ``ids_crc32`` (of the little-endian ids) comes
    instead of the ids, worked out where they are made.  Texts of any length are cut into as many windows as they fill;
    an empty table gives no pieces; other columns are not read.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_packed(vocabulary, end_id, tuple(sorted(tiers, reverse=True)), step_tokens, checksums),
                           f"{_PLACE_DDL}, {'ids_crc32 bigint' if checksums else 'ids binary'}")
