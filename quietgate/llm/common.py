"""Shared helpers: cut lineage in the shared folder, words and shingles as 64-bit hashes in numpy, Arrow plumbing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
ROWS_A_PART = 200_000  # of a compact table of few narrow columns
_KNOWN_WORDS = 300_000  # remembered hashes per worker; beyond it the memory is emptied


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; on one machine, beside the warehouse where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage: a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def compact(df: DataFrame) -> DataFrame:
    """A cut table in as few partitions as its rows need.

    A small table in many partitions leaves a file for each of them in every shuffle that follows; a large one stays as it is.
    """
    return df.coalesce(max(1, -(-df.count() // ROWS_A_PART)))


def small(df: DataFrame, most: int) -> bool:
    """At most ``most`` rows; decides whether a side may be broadcast."""
    return df.limit(most + 1).count() <= most


def held_out(key: Column, parts: int, part: int) -> Column:
    """crc32 of the key as text, modulo ``parts``, is ``part``; a null key is not held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_seen = _WordHashes()
Batches = Iterable[pa.RecordBatch]
Made = Iterator[pa.RecordBatch]


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased; bytes.split() splits at exactly x20 and x09-x0D."""
    return text.translate(_LOWER).split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_seen) > _KNOWN_WORDS:
        _seen.clear()
    return np.fromiter(map(_seen.__getitem__, words), np.uint64, len(words))


def mixed(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` items, in order."""
    runs = len(hashes) - size + 1
    out = np.full(runs, 0x9E3779B97F4A7C15, np.uint64)
    for i in range(size):
        out ^= hashes[i:i + runs]
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(29)
    return out


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct shingles; a shorter text is one shingle, a text without words has none."""
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    if len(hashes) < size:
        return mixed(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return np.unique(mixed(hashes, size))


def in_slices(batches: Batches, forget: Callable[[], None], rows: int = 512) -> Made:
    """Batches in small slices, so that what a worker makes of one stays small; at the end it forgets what it remembered."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        forget()


def give_back() -> None:
    """Workers live on between tasks; what a task has freed goes back to the system, where that is glibc."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def forget_words() -> None:
    """Workers live on between tasks and should not keep a task's memory."""
    _seen.clear()
    give_back()


def texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
