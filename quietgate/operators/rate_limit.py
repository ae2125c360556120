"""Adaptive rate limiting over an event log, split so that a busy user spreads over many tasks.

Input: ``user_id, event_id, ts, kind`` with kind one of check, warning, block, reset.

The limiter is a fold: each window starts at the first check that comes at least ``seconds`` after
the start of the window before.  A fold cannot be split, but what one slice of a history does to *any*
incoming state can be described without knowing that state:

1. tiers depend on counts of violations only, hence on running totals;
2. every slice of a busy user is summarised as a function "window start in -> window start and tokens
   out", a short list of break points, all slices in parallel;
3. the summaries of a user, one row per slice, are chained;
4. every slice is replayed from its now known incoming state, again in parallel.

Users that are not busy are one slice, which opens by itself.  Within a slice the fold is unrolled by jump
pointers: from every check to the one that would start the next window, then twice, four times, ... as far.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quietgate import fixed_values as v
from quietgate.functions.running import Ranges, given_ranges, micros, ranges, slice_of

SECOND = 1_000_000
KEYS = ["user_id", "epoch", "__slice"]
BEFORE_ALL = -(1 << 62)  # place of a state row in the order of events


@dataclass(frozen=True)
class Settings:
    limits: Mapping[str, int] = field(default_factory=lambda: dict(v.TIER_LIMITS))
    seconds: float = v.LIMIT_SECONDS
    warnings: int = v.WARNINGS_TO_ESCALATE
    blocks: int = v.BLOCKS_TO_ESCALATE
    slice_windows: int | None = None  # windows per slice, or None: slices of busy users by their number of events


def tier_of(warnings: Column, blocks: Column, settings: Settings) -> Column:
    return (F.when(blocks >= settings.blocks, F.lit("restricted"))
            .when(warnings >= settings.warnings, F.lit("warning")).otherwise(F.lit("normal")))


def _slices(events: DataFrame, settings: Settings) -> Ranges:
    moment = micros(F.col("ts"))
    if "__state" in events.columns:
        moment = F.when(F.col("kind") == "state", F.lit(BEFORE_ALL)).otherwise(moment)
    placed = events.withColumn("__at", moment)
    if settings.slice_windows is None:
        return ranges(placed, ["user_id"], ["__at", "event_id"], "__slice")
    width = int(settings.seconds * SECOND) * settings.slice_windows
    return given_ranges(placed.withColumn("__slice", slice_of(F.col("__at"), width)), "__slice")


def _tiers(cut: Ranges, settings: Settings) -> DataFrame:
    """Rows of ``cut`` with ``epoch, warning_count, block_count, tier``; a row of kind state brings counts of its own."""
    order, up_to_here = ["__at", "event_id"], (Window.unboundedPreceding, 0)
    is_kind = lambda k: (F.col("kind") == k).cast("bigint")
    counts = {"warning": is_kind("warning"), "block": is_kind("block")}
    if "__state" in cut.rows.columns:
        counts = {k: F.when(F.col("kind") == "state", F.col(f"__state.{k}s")).otherwise(c) for k, c in counts.items()}
    in_slice = Window.partitionBy("user_id", "__slice").orderBy(*order).rowsBetween(*up_to_here)
    parted = cut.rows.withColumn("__part", F.sum(is_kind("reset")).over(in_slice))
    since_reset = Window.partitionBy("user_id", "__slice", "__part").orderBy(*order).rowsBetween(*up_to_here)
    counted = parted.select("*", F.sum(counts["warning"]).over(since_reset).alias("__w"),
                            F.sum(counts["block"]).over(since_reset).alias("__b"))
    before, untouched = (lambda c: F.lit(0)), F.col("__part") == 0
    if cut.split:
        # What a slice hands on: its resets, and its violations since the last one or all without one.
        kinds = cut.rows.where(cut.many).select(
            "user_id", "__slice", "kind", F.struct(*order).alias("__place"), *(c.alias(f"__{k}") for k, c in counts.items()))
        resets = kinds.where(F.col("kind") == "reset").groupBy("user_id", "__slice").agg(
            F.count("*").alias("__part"), F.max("__place").alias("__reset"))
        held = kinds.join(F.broadcast(resets) if cut.few else resets, ["user_id", "__slice"], "left")
        after = F.col("__reset").isNull() | (F.col("__place") > F.col("__reset"))
        ends = held.groupBy("user_id", "__slice").agg(
            F.coalesce(F.max("__part"), F.lit(0)).alias("__part"), *(F.coalesce(F.sum(F.when(after, F.col(f"__{k}"))), F.lit(0)).alias(n)
                                                                   for k, n in (("warning", "__w"), ("block", "__b"))))
        by_slice = Window.partitionBy("user_id").orderBy("__slice")
        runs = ends.withColumn("__run", F.sum((F.col("__part") > 0).cast("int")).over(by_slice.rowsBetween(*up_to_here)))
        run = Window.partitionBy("user_id", "__run").orderBy("__slice").rowsBetween(*up_to_here)
        totals = runs.select("user_id", "__slice", F.struct(
            F.sum("__part").over(by_slice.rowsBetween(*up_to_here)).alias("epoch"),
            F.sum("__w").over(run).alias("w"), F.sum("__b").over(run).alias("b")).alias("__total"))
        carried = totals.select("user_id", "__slice", F.lag("__total").over(by_slice).alias("__carried"))
        counted = cut.with_carried(counted, ["user_id"], carried, "__carried")
        before = lambda c: F.coalesce(F.col(f"__carried.{c}"), F.lit(0))
    return counted.select(
        *cut.rows.columns, (F.col("__part") + before("epoch")).alias("epoch"),
        (F.col("__w") + F.when(untouched, before("w")).otherwise(0)).alias("warning_count"),
        (F.col("__b") + F.when(untouched, before("b")).otherwise(0)).alias("block_count"),
    ).withColumn("tier", tier_of(F.col("warning_count"), F.col("block_count"), settings))


def tiers(events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Add the reset epoch, the violation counts inside it and the tier after every event.

    Counts run inside (user, slice) and restart at every reset.  A slice hands on what was counted
    since its last reset, so each event needs one carried row; events are shuffled by (user, slice) only.
    """
    return _tiers(_slices(events, settings), settings).select(
        *events.columns, "epoch", "warning_count", "block_count", "tier")


def _doubled(jumps: np.ndarray) -> list[np.ndarray]:
    """Jump pointers 1, 2, 4, ... steps far; the last index is the end, which leads to itself."""
    levels = [jumps]
    while (levels[-1] != len(jumps) - 1).any() and 1 << len(levels) <= len(jumps):
        levels.append(levels[-1][levels[-1]])
    return levels


def _summarise(rows: dict[str, np.ndarray], window: int) -> dict:
    """The slice as a function of the incoming window start."""
    at, limit_at, is_check, changed = rows["at"], rows["limit"], rows["is_check"], np.flatnonzero(rows["changed"])
    where = np.flatnonzero(is_check)
    checks, n = at[where], len(where)
    checks_from = n - np.concatenate([[0], np.cumsum(is_check)])[:-1]  # checks from each row to the end
    last_change = int(changed[-1]) if len(changed) else -1

    # The last window start reached from each check, were it one itself.
    following = np.searchsorted(checks, checks + window, side="left")
    final = np.arange(n)
    for level in reversed(_doubled(np.append(following, n))):
        onward = level[final]
        final = np.where(onward < n, onward, final)
    # Neighbouring checks that end in the same window share one break point.
    ends = np.flatnonzero(np.append(final[1:] != final[:-1], True)) if n else np.arange(0)
    last_start = where[final[ends]] if n else np.arange(0)
    # Tokens were last set by that window start or by a later tier change.
    set_at = np.maximum(last_start, last_change)
    left = np.maximum(limit_at[set_at] - checks_from[set_at], 0)
    idle = max(int(limit_at[last_change] - checks_from[last_change]), 0) if last_change >= 0 else None
    return {"upto": checks[ends].tolist(), "start_out": at[last_start].tolist(), "tokens_out": left.tolist(),
            "checks": n, "idle_tokens": idle}


def _next_checks(group: np.ndarray, since: np.ndarray, check_group: np.ndarray, check_at: np.ndarray) -> np.ndarray:
    """Number of the first check of each given group that is not before ``since``; the number of checks for none."""
    n = len(check_at)
    order = np.lexsort((np.repeat([0, 1], [len(since), n]), np.concatenate([since, check_at]), np.concatenate([group, check_group])))
    before = np.cumsum(order >= len(since))
    found = np.empty(len(since), np.int64)
    asked = order < len(since)
    found[order[asked]] = before[asked]
    inside = found < n
    inside[inside] = check_group[found[inside]] == group[inside]
    return np.where(inside, found, n)


def replayed(group: np.ndarray, at: np.ndarray, is_check: np.ndarray, limit: np.ndarray, changed: np.ndarray,
             start: np.ndarray, tokens: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(allowed, tokens left, window start, seconds to wait) of rows in order, for any number of groups at once.

    ``group`` numbers the groups from 0; ``start`` and ``tokens`` are the state each one comes with.  Every segment from
    one setting of the tokens to the next is plain counting: its n-th check is allowed while n does not exceed them.
    """
    where = np.flatnonzero(is_check)
    check_group, check_at, n = group[where], at[where], len(where)
    jumps = _next_checks(np.concatenate([check_group, np.arange(len(start))]), np.concatenate([check_at, start]) + window,
                         check_group, check_at)
    opens = np.zeros(n + 1, bool)  # checks that start a window: all on the way from the first one of a group
    opens[jumps[n:]] = True
    for level in reversed(_doubled(np.append(jumps[:n], n))):
        opens[level[np.flatnonzero(opens)]] = True

    begins = np.append(True, group[1:] != group[:-1])
    starts = np.zeros(len(at), bool)
    starts[where[opens[:n]]] = True
    rows = np.arange(len(at))
    window_row = np.maximum.accumulate(np.where(begins | starts, rows, 0))
    window_start = np.where(starts[window_row], at[window_row], start[group])
    set_row = np.maximum.accumulate(np.where(begins | starts | changed, rows, 0))
    given = np.where((starts | changed)[set_row], limit[set_row], tokens[group])
    checks = np.cumsum(is_check)
    nth = checks - checks[set_row] + is_check[set_row]
    allowed = is_check & (nth <= given)
    wait = np.where(is_check & ~allowed, np.maximum(window_start + window - at, 0) / SECOND, np.nan)
    return allowed, np.maximum(given - nth, 0), window_start, wait


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Contiguous groups of sorted batches as arrays; the pieces of a group are put together once, at its end."""
    pieces: list[dict[str, np.ndarray]] = []

    def whole() -> dict[str, np.ndarray]:
        return {c: np.concatenate([p[c] for p in pieces]) for c in pieces[0]} if len(pieces) > 1 else pieces[0]

    for batch in batches:
        if batch.empty:
            continue
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        new = np.any([columns[k][1:] != columns[k][:-1] for k in keys], axis=0)
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(batch)]
        for first, stop in zip(edges, edges[1:]):
            if pieces and any(pieces[0][k][0] != columns[k][first] for k in keys):
                yield whole()
                pieces = []
            pieces.append({c: x[first:stop] for c, x in columns.items()})
    if pieces:
        yield whole()


def _summaries(window: int, normal: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = []
        for rows in _groups(batches, KEYS):
            user, epoch, number = (rows[k][0] for k in KEYS)
            opened, given = int(rows["at"][0]), normal
            if rows["opens"][0]:
                given, rows = int(rows["limit"][0]), {c: x[1:] for c, x in rows.items()}
            found.append({"user_id": user, "epoch": epoch, "slice": number, "opened": opened, "given": given,
                          **_summarise(rows, window)})
            if len(found) >= 1000:
                yield pd.DataFrame(found)
                found = []
        if found:
            yield pd.DataFrame(found)
    return run


def _chained(window: int):
    """Walk the slices of every user in order; the state is one window start and one token count."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, tokens = None, 0, 0
        for batch in batches:
            out = []
            for s in batch.itertuples(index=False):
                if key != (s.user_id, s.epoch):
                    key, start, tokens = (s.user_id, s.epoch), int(s.opened), int(s.given)
                out.append((*key, s.slice, start, tokens))
                i = int(np.searchsorted(np.asarray(s.upto, dtype=np.int64), start + window, side="left"))
                if i < len(s.upto):
                    start, tokens = int(s.start_out[i]), int(s.tokens_out[i])
                elif not pd.isna(s.idle_tokens):
                    tokens = int(s.idle_tokens)
                else:
                    tokens = max(tokens - int(s.checks), 0)
            yield pd.DataFrame(out, columns=["user_id", "epoch", "slice", "start_in", "tokens_in"])
    return run


def _replayed(window: int, normal: int, every: bool):
    """Replay sorted rows batch by batch; of a group only its state is kept from one batch to the next.

    A group opens with a row that holds its incoming state, or by itself with its first event.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, tokens = None, 0, 0
        for batch in batches:
            if batch.empty:
                continue
            c = {name: batch[name].to_numpy() for name in batch.columns}
            first = (c["user_id"][0], c["epoch"][0], c["__slice"][0])
            changes = np.any([c[k][1:] != c[k][:-1] for k in KEYS], axis=0)
            group = np.concatenate([[0], np.cumsum(changes)])
            begin = np.concatenate([[0], np.flatnonzero(changes) + 1])
            starts, given = c["at"][begin], np.where(c["opens"][begin], c["limit"][begin], normal)
            if key == first:
                starts[0], given[0] = start, tokens
            allowed, remaining, window_start, wait = replayed(
                group, c["at"], c["is_check"], c["limit"].astype(np.int64), c["changed"], starts, given.astype(np.int64), window)
            key, start, tokens = tuple(c[k][-1] for k in KEYS), window_start[-1], remaining[-1]
            done = batch.assign(allowed=allowed, remaining=remaining.astype(np.int32), window_start=window_start, retry_after=wait)
            yield (done if every else done.loc[done["is_check"]])[[
                "user_id", "event_id", "at", "tier", "limit", "allowed", "remaining", "window_start", "retry_after",
                *(["epoch", "opens", "is_check"] if every else [])]]
    return run


def _with_state(events: DataFrame, state: DataFrame) -> DataFrame:
    """Events and, before each user's first one, a row of the state left by earlier events."""
    fields = ("window_start", "tokens", "warnings", "blocks")
    kind = "struct<window_start:bigint,tokens:int,warnings:bigint,blocks:bigint>"
    types = dict(events.dtypes)
    rows = state.where("tokens is not null").select(
        "user_id", F.lit(0).cast(types["event_id"]).alias("event_id"), F.lit(None).cast(types["ts"]).alias("ts"),
        F.lit("state").alias("kind"), F.struct(*fields).cast(kind).alias("__state"))
    return events.select("user_id", "event_id", "ts", "kind", F.lit(None).cast(kind).alias("__state")).unionByName(rows)


def _decided(events: DataFrame, settings: Settings, every: bool) -> tuple[DataFrame, DataFrame]:
    """Rows replayed, all of them if ``every``, and the rows with their tiers; ``events`` may hold state rows."""
    window, normal = int(settings.seconds * SECOND), settings.limits["normal"]
    key_type = dict(events.dtypes)["user_id"]
    id_type = dict(events.dtypes)["event_id"]
    limit = F.create_map(*(x for k, n in settings.limits.items() for x in (F.lit(k), F.lit(n))))
    cut = _slices(events, settings)
    tiered = _tiers(cut, settings)
    before = tier_of(F.col("warning_count") - (F.col("kind") == "warning").cast("int"),
                     F.col("block_count") - (F.col("kind") == "block").cast("int"), settings)
    opens, at, tokens = F.lit(False), F.col("__at"), F.element_at(limit, F.col("tier")).cast("int")
    if "__state" in events.columns:
        opens = F.col("kind") == "state"
        at, tokens = F.when(opens, F.col("__state.window_start")).otherwise(at), F.when(opens, F.col("__state.tokens")).otherwise(tokens)
    rows = tiered.where(F.col("kind") != "reset").select(
        "user_id", "epoch", "__slice", opens.alias("opens"), at.alias("at"), "event_id", "tier", tokens.alias("limit"),
        (F.col("kind") == "check").alias("is_check"), (~opens & (F.col("tier") != before)).alias("changed"), cut.many.alias("__busy"))
    # The work is in Python rather than in bytes, so small partitions are not merged.
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if cut.split:
        # Sorted partitions are streamed through Python in batches; no group is held but the slice being summarised.
        summaries = rows.where("__busy").drop("__busy").repartition(tasks, *KEYS).sortWithinPartitions(
            *KEYS, F.col("opens").desc(), "at", "event_id").mapInPandas(
            _summaries(window, normal),
            f"user_id {key_type}, epoch bigint, slice bigint, opened bigint, given int, upto array<bigint>, start_out array<bigint>, "
            "tokens_out array<int>, checks bigint, idle_tokens double")
        states = summaries.repartition(tasks, "user_id", "epoch").sortWithinPartitions("user_id", "epoch", "slice").mapInPandas(
            _chained(window),
            f"user_id {key_type}, epoch bigint, slice bigint, start_in bigint, tokens_in int")
        opening = states.select(
            "user_id", "epoch", F.col("slice").alias("__slice"), F.lit(True).alias("opens"), F.col("start_in").alias("at"),
            F.lit(0).cast(id_type).alias("event_id"), F.lit("").alias("tier"), F.col("tokens_in").alias("limit"),
            F.lit(False).alias("is_check"), F.lit(False).alias("changed"))
        rows = rows.where("not (opens and __busy)").drop("__busy").unionByName(opening)
    # The state joins its slice as its first row: one shuffle instead of a join and a grouping.
    replayed_rows = rows.drop("__busy").repartition(tasks, *KEYS).sortWithinPartitions(
        *KEYS, F.col("opens").desc(), "at", "event_id").mapInPandas(
        _replayed(window, normal, every),
        f"user_id {key_type}, event_id {id_type}, at bigint, tier string, limit int, allowed boolean, remaining int, "
        f"window_start bigint, retry_after double{', epoch bigint, opens boolean, is_check boolean' if every else ''}")
    return replayed_rows, tiered


def _decisions(rows: DataFrame, settings: Settings) -> DataFrame:
    return rows.select(
        "user_id", "event_id", F.timestamp_micros("at").alias("ts"), "allowed", "remaining", "limit", "tier",
        F.timestamp_micros(F.col("window_start") + int(settings.seconds * SECOND)).alias("reset_time"), "retry_after")


def check(events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Decision for every check: ``allowed, remaining, limit, tier, reset_time, retry_after``."""
    return _decisions(_decided(events.select("user_id", "event_id", "ts", "kind"), settings, False)[0], settings)


def check_from(events: DataFrame, state: DataFrame | None, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Decisions that continue from a state, and the state after all events: (user_id, window_start, tokens, warnings, blocks).

    ``state`` is what this function left after earlier events; users without one begin anew, and a user whose last event
    is a reset has nulls.  Only users with events have a row in the new state.
    """
    own = events.select("user_id", "event_id", "ts", "kind")
    if state is not None:
        own = _with_state(own, state)
    rows, tiered = _decided(own, settings, True)
    place = F.struct("epoch", (~F.col("opens")).alias("later"), "at", "event_id")
    buckets = rows.groupBy("user_id", "epoch").agg(F.max_by(F.struct("window_start", F.col("remaining").alias("tokens")), place).alias("b"))
    ends = tiered.groupBy("user_id").agg(F.max_by(F.struct("epoch", "warning_count", "block_count"), F.struct("epoch", "__at", "event_id")).alias("e"),
                                         F.count_if(F.col("kind") != "state").alias("events")).where("events > 0")
    found = ends.select("user_id", "e.*").join(
        buckets.select(F.col("user_id").alias("__user"), F.col("epoch").alias("__epoch"), "b"),
        F.col("user_id").eqNullSafe(F.col("__user")) & (F.col("epoch") == F.col("__epoch")), "left")
    after = found.select("user_id", "b.window_start", "b.tokens", F.when(F.col("b").isNotNull(), F.col("warning_count")).alias("warnings"),
                         F.when(F.col("b").isNotNull(), F.col("block_count")).alias("blocks"))
    return _decisions(rows.where("is_check"), settings), after
