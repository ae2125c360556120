"""Running totals and neighbours over an ordered history, split so that no key has to fit one task.

A plain window partitioned by user sends a user's whole history to one task.  Here the histories of busy keys are cut by
ranges of (key, order), as a range partitioning would cut them: the edges are read off a sample of bounded size, so
every range holds about the same number of rows whatever the skew and however many rows share a moment.  Windows run
inside (key, range); what earlier ranges contribute arrives as one small carried row per range.  Keys that are not
busy are one range, and without any busy key the plan is the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

SAMPLES = 32      # sampled rows per range: the more, the more even the ranges
MOST_RANGES = 4096  # edges travel to every task, so their number has a bound


def micros(ts: Column) -> Column:
    """Timestamp (with or without zone) as microseconds."""
    return F.unix_micros(ts.cast("timestamp"))


def slice_of(at: Column, width: int) -> Column:
    """Number of the slice of ``width`` units; whole-number division keeps every digit of a microsecond count."""
    return F.call_function("div", at - F.pmod(at, F.lit(width)), F.lit(width))


def rank(edges: Column, value: Column, most: int, strictly: bool = False) -> Column:
    """How many of at most ``most`` sorted edges are at most (``strictly``: less than) ``value``, by binary search."""
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(max(1, most.bit_length())))))

    def onward(at: Column, step: Column) -> Column:
        edge = F.get(edges, at + step - 1)
        return at + F.when(edge < value if strictly else edge <= value, step).otherwise(F.lit(0))

    return F.aggregate(steps, F.lit(0), onward)


@dataclass(frozen=True)
class Ranges:
    """Rows with the number of their range in ``column``; ``split`` tells whether any key has more than one.

    ``many`` marks the rows of such keys.  Ranges that were sampled are few, so one row for each may be broadcast.
    """

    rows: DataFrame
    column: str
    split: bool
    many: Column
    few: bool

    def with_carried(self, rows: DataFrame, keys: Sequence[str], totals: DataFrame, *values: str) -> DataFrame:
        """``rows`` with the values that ``totals`` has for their key and range, null where it has none."""
        names = [*keys, self.column]
        side = totals.select(*(F.col(n).alias(f"__key{i}") for i, n in enumerate(names)), *values)
        equal = F.lit(True)
        for i, n in enumerate(names):  # rows with a null key belong together
            equal = equal & F.col(n).eqNullSafe(F.col(f"__key{i}"))
        return rows.join(F.broadcast(side) if self.few else side, equal, "left").select(*rows.columns, *values)


def given_ranges(df: DataFrame, column: str) -> Ranges:
    """Rows cut by a column of their own that follows the order."""
    return Ranges(df, column, True, F.lit(True), False)


def ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str = "__range", count: int | None = None) -> Ranges:
    """Number the rows of every key by ranges of ``order``, such that a range holds about 1 / ``count`` of all rows.

    Order columns are not null and tell rows of a key apart.  The sample is the rows with the smallest hash of key and
    order: bounded, the same for any partitioning, and found without a shuffle of the rows.  By default there are two
    ranges for every shuffle partition.  Only keys with at least two ranges' worth of rows are cut.
    """
    wanted = min(count or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES)
    sample = df.select(*keys, *order).orderBy(F.xxhash64(*keys, *order)).limit(SAMPLES * wanted)
    # The sample, not the data, is grouped: all groups together have at most SAMPLES * MOST_RANGES entries.
    seen = sample.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("__seen"))
    found = seen.where(F.size("__seen") >= 2 * SAMPLES).select(
        *keys, F.filter("__seen", lambda _, i: (i > 0) & (F.pmod(i, F.lit(SAMPLES)) == 0)).alias("__edges"))
    edges = found.collect()  # at most MOST_RANGES edges in all
    many = f"{column}_many"
    if not edges:
        return Ranges(df.select("*", F.lit(0).alias(column), F.lit(False).alias(many)), column, False, F.col(many), True)
    names = [f"__key{i}" for i in range(len(keys))]
    table = df.sparkSession.createDataFrame(edges, found.schema).toDF(*names, "__edges")
    equal = F.lit(True)
    for key, name in zip(keys, names):
        equal = equal & F.col(key).eqNullSafe(F.col(name))
    at = rank(F.col("__edges"), F.struct(*order), max(len(e["__edges"]) for e in edges))
    joined = df.join(F.broadcast(table), equal, "left").select(
        *df.columns, F.when(F.col("__edges").isNotNull(), at).otherwise(F.lit(0)).alias(column), F.col("__edges").isNotNull().alias(many))
    return Ranges(joined, column, True, F.col(many), True)


def _cut(df: DataFrame, keys: Sequence[str], order: Sequence[str], by: str | Ranges | None) -> Ranges:
    return by if isinstance(by, Ranges) else ranges(df, keys, order) if by is None else given_ranges(df, by)


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], by: str | Ranges | None,
                 measures: Mapping[str, Column]) -> DataFrame:
    """Add running sums (up to and including the row) of ``measures`` per key, in ``order``.

    ``by`` is a column that cuts the histories along their order, ranges made before, or None to find them here.
    """
    hidden = {name: f"__m_{name}" for name in measures}
    cut = _cut(df, keys, order, by)
    held = cut.rows.select("*", *(c.cast("bigint").alias(hidden[n]) for n, c in measures.items()))
    within = Window.partitionBy(*keys, cut.column).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = {h: F.lit(0) for h in hidden.values()}
    if cut.split:
        earlier = Window.partitionBy(*keys).orderBy(cut.column).rowsBetween(Window.unboundedPreceding, -1)
        per_range = held.where(cut.many).groupBy(*keys, cut.column).agg(*(F.sum(h).alias(h) for h in hidden.values()))
        totals = per_range.select(*keys, cut.column, *(F.sum(h).over(earlier).alias(f"{h}_carried") for h in hidden.values()))
        held = cut.with_carried(held, keys, totals, *(f"{h}_carried" for h in hidden.values()))
        before = {h: F.coalesce(f"{h}_carried", F.lit(0)) for h in hidden.values()}
    return held.select(*df.columns, *((F.sum(h).over(within) + before[h]).alias(n) for n, h in hidden.items()))


def with_previous(df: DataFrame, keys: Sequence[str], order: str, by: str | Ranges | None, columns: Sequence[str],
                  prefix: str = "prev_") -> DataFrame:
    """Add the columns of the directly preceding row of the same key; ``by`` as in ``running_sums``."""
    value = F.struct(*columns)
    cut = _cut(df, keys, [order], by)
    within = Window.partitionBy(*keys, cut.column).orderBy(order)
    rows, previous = cut.rows, F.lag(value).over(within)
    if cut.split:
        by_range = Window.partitionBy(*keys).orderBy(cut.column)
        last = rows.where(cut.many).groupBy(*keys, cut.column).agg(F.max_by(value, order).alias("__last"))
        carried = last.select(*keys, cut.column, F.lag("__last").over(by_range).alias("__carried"))
        rows = cut.with_carried(rows, keys, carried, "__carried")
        # A row with no predecessor inside its range takes the last row of the range before.
        previous = F.when(F.row_number().over(within) > 1, previous).otherwise(F.col("__carried"))
    return rows.withColumn("__prev", previous).select(
        *df.columns, *(F.col(f"__prev.{c}").alias(f"{prefix}{c}") for c in columns))
