"""The adaptive rate limiter over an event stream: one small bucket of state per user."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quietgate.functions.running import micros
from quietgate.operators.rate_limit import SECOND, Settings, check_from
from quietgate.streaming import micro_batches

STATE = "tokens int, window_start bigint, tier string, warnings int, blocks int"
OUTPUT = (
    "user_id string, event_id bigint, at bigint, allowed boolean, remaining int, limit int, tier string, "
    "reset_at bigint, retry_after double"
)


class Bucket:
    """Tokens, window and tier of one user; the order of calls is the order of events."""

    def __init__(self, settings: Settings, tokens: int, start: int, tier: str = "normal", warnings: int = 0, blocks: int = 0):
        self.settings, self.tokens, self.start = settings, tokens, start
        self.tier, self.warnings, self.blocks = tier, warnings, blocks

    @property
    def state(self) -> tuple:
        return self.tokens, self.start, self.tier, self.warnings, self.blocks

    def violation(self, blocked: bool) -> None:
        self.blocks += blocked
        self.warnings += not blocked
        s = self.settings
        tier = "restricted" if self.blocks >= s.blocks else "warning" if self.warnings >= s.warnings else "normal"
        if tier != self.tier:
            self.tier, self.tokens = tier, s.limits[tier]

    def check(self, at: int) -> tuple:
        window, limit = int(self.settings.seconds * SECOND), self.settings.limits[self.tier]
        if at - self.start >= window:
            self.tokens, self.start = limit, at
        allowed = self.tokens > 0
        self.tokens -= allowed
        wait = None if allowed else max(self.start + window - at, 0) / SECOND
        return allowed, self.tokens, limit, self.tier, self.start + window, wait


class LimiterProcessor(StatefulProcessor):
    def __init__(self, settings: Settings) -> None:
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bucket = Bucket(self.settings, *self.bucket.get()) if self.bucket.exists() else None
        out = []
        for r in pd.concat(rows).sort_values(["at", "event_id"]).itertuples(index=False):
            if r.kind == "reset":
                bucket = None
                continue
            bucket = bucket or Bucket(self.settings, self.settings.limits["normal"], int(r.at))
            if r.kind == "check":
                out.append((key[0], int(r.event_id), int(r.at), *bucket.check(int(r.at))))
            else:
                bucket.violation(r.kind == "block")
        if bucket is None:
            self.bucket.clear()
        else:
            self.bucket.update(bucket.state)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def check(events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Decision per check of a stream with ``user_id, event_id, ts, kind``."""
    rows = events.select("user_id", "event_id", "kind", micros(F.col("ts")).alias("at"))
    decided = rows.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=LimiterProcessor(settings), outputStructType=OUTPUT, outputMode="Append", timeMode="None")
    return decided.select(
        "user_id", "event_id", F.timestamp_micros("at").alias("ts"), "allowed", "remaining", "limit", "tier",
        F.timestamp_micros("reset_at").alias("reset_time"), "retry_after")


def start(events: DataFrame, path: str, checkpoint: str, settings: Settings = Settings(), delay_seconds: float = 10 ** 9, **trigger):
    """Decisions of a stream through the batch operator (``micro_batches``), written under ``path``.

    Unlike ``check`` it takes any number of rows of one user in a micro-batch, and sets rows that are not after their
    user's last one apart.  The state is one row per user seen in the last ``delay_seconds``; a user forgotten begins
    anew, so take them longer than violations should count.
    """
    rows = events.select("user_id", "event_id", "ts", "kind", micros(F.col("ts")).alias("at"))

    def judge(fresh: DataFrame, before: DataFrame | None, newest: int) -> tuple[DataFrame, DataFrame]:
        users = fresh.groupBy("user_id").agg(F.max(F.struct("at", "event_id")).alias("clock"))
        mine = F.col("user_id").eqNullSafe(F.col("__user"))
        present = users.select(F.col("user_id").alias("__user"))
        decisions, after = check_from(fresh, None if before is None else before.join(present, mine, "left_semi"), settings)
        state = after.join(users.select(F.col("user_id").alias("__user"), "clock"), mine).drop("__user")
        if before is not None:
            rest = before.join(present, mine, "left_anti").where(F.col("clock.at") >= newest - int(delay_seconds * SECOND))
            state = state.unionByName(rest)
        return decisions, state

    return micro_batches.start(rows, judge, path, checkpoint, delay_seconds, **trigger)
