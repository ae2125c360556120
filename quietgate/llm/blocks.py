"""Documents in ordered blocks of bounded size, and questions that blocks put to shards of a key space.

Facts about a whole corpus that every document needs back (has this window been seen before? how often do these two ids
meet?) would cost a row per occurrence on the way there and another on the way back.  Here a block of documents asks
once for each distinct key it has, packed into one row per shard; a shard answers each block in the order asked.  Texts
are shuffled once: the blocks that ask and those that use the answers share one exchange.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quietgate.llm.common import record

BLOCK_BYTES = 8 << 20  # text in a block, which one task holds
ROW_BYTES = 32         # that a row costs besides its text
MESSAGE = pa.schema([("origin", pa.int32()), ("shard", pa.int32()), ("body", pa.binary())])
MESSAGE_DDL = "origin int, shard int, body binary"
_FIRST = -(1 << 63)    # place of a null key, before all others


def in_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(key, text, block) of every row, and the bytes of all texts.

    Blocks follow the order of the whole-number keys, null first: every key of a block comes before those of the next.
    Their edges are quantiles of the keys weighted by the bytes of the texts.  Where one key fills several blocks, its
    rows are dealt over them by a hash, so neither a hot key nor many rows without one meet in one task.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    total = rows.agg(F.sum(size)).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    if count == 1:
        return rows.withColumn("block", F.lit(0)), total
    place = F.coalesce(F.col("key"), F.lit(_FIRST))
    weighted = rows.select(F.explode(F.array_repeat(place, F.ceil(size / max(1, block_bytes // 64)).cast("int"))).alias("place"))
    shares = [i / count for i in range(1, count)]
    edges = np.array(weighted.agg(F.percentile_approx("place", shares, max(10_000, 20 * count))).first()[0], np.int64)

    @F.pandas_udf("int")
    def block_of(place: pd.Series, salt: pd.Series) -> pd.Series:
        at = place.to_numpy()
        first, last = np.searchsorted(edges, at, "left"), np.searchsorted(edges, at, "right")
        return pd.Series((first + salt.to_numpy() % (last - first + 1)).astype(np.int32))

    salt = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1 << 31))
    return rows.withColumn("block", block_of(place, salt)), total


def dealt(rows: DataFrame, by: str) -> DataFrame:
    """Rows partitioned by a column, for more than one use of the same exchange."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def asked(groups: DataFrame, by: str, ask, answer, finish, ddl: str) -> DataFrame:
    """``finish(group, answers)`` of every group of ``groups``, after its ``ask(group)`` went through ``answer(shard)``.

    ``ask`` and ``answer`` take an Arrow table and return messages (origin, shard, body): ``ask`` addresses shards and
    gives its group as origin, ``answer`` replies to origins.
    """
    questions = groups.groupBy(by).applyInArrow(ask, MESSAGE_DDL)
    answers = questions.groupBy("shard").applyInArrow(answer, MESSAGE_DDL)
    return groups.groupBy(by).cogroup(answers.groupBy("origin")).applyInArrow(finish, ddl)


def messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    origin, shard, body = zip(*rows) if rows else ((),) * 3
    return pa.Table.from_batches([record(MESSAGE, origin, shard, body)])


def in_order(table: pa.Table, column: str) -> list[tuple[int, int, bytes]]:
    """Messages as (origin, shard, body), ordered by one column."""
    table = table.sort_by(column)
    return list(zip(*(table.column(c).to_pylist() for c in ("origin", "shard", "body"))))


def parts_of(shards: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, first, stop) of every run of equal numbers."""
    if not len(shards):
        return []
    edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
    return [(int(shards[a]), a, b) for a, b in zip(edges, edges[1:])]


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit keys as differences of as few bytes each as the largest one needs."""
    gaps = np.diff(keys)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + keys[:1].tobytes() + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(body: bytes) -> np.ndarray:
    width = body[0]
    gaps = np.zeros(((len(body) - 9) // width, 8), np.uint8)
    gaps[:, :width] = np.frombuffer(body, np.uint8, offset=9).reshape(-1, width)
    out = np.empty(len(gaps) + 1, np.uint64)
    out[0] = np.frombuffer(body, np.uint64, 1, 1)[0]
    out[1:] = gaps.reshape(-1).view(np.uint64)
    return np.cumsum(out)
