"""Abuse patterns over an event stream, with bounded state per user.

State is the user's history: at most ``max_rows`` entries no older than ``seconds``.  A timer
drops it once the watermark has passed its last entry by that time.  Rows of one user in one
micro-batch are ordered by (ts, event_id); rows older than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quietgate import fixed_values as v
from quietgate.functions.running import micros, running_sums
from quietgate.operators import behavior
from quietgate.operators.behavior import FLAGS, SECOND, Limits, attempt_of
from quietgate.streaming import micro_batches

STATE = "event_id bigint, at bigint, inj boolean, tox boolean, blk boolean, conf double, attempt string"
ROW = ("at", "event_id", "was_injection", "was_toxic", "was_blocked", "confidence", "attempt", "is_reset")
OUTPUT = (
    "user_id string, event_id bigint, at bigint, n bigint, n_injection bigint, n_toxic bigint, n_blocked bigint, "
    "risk_score double, is_abusive boolean, abuse_type string, abuse_confidence double, recommended_action string"
)


COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


def judge(history: list[tuple], limits: Limits, injected: int | None = None) -> tuple[str | None, float, str]:
    """(abuse type, confidence, action) of a history of (event_id, at, inj, tox, blk, conf, attempt).

    ``injected`` is the history's number of injections, where it is known.
    """
    tried = [h[6] for h in history[-v.JAILBREAK_ROWS:] if h[2]]
    if len(tried) >= v.JAILBREAK_HITS:
        share = len(set(tried)) / len(tried)
        if share >= v.JAILBREAK_SHARE:
            return "jailbreak_sequence", share, "block"
    if len(history) >= limits.escalation_window:
        levels = [h[5] for h in history[-limits.escalation_window:] if h[2] or h[3]]
        if len(levels) >= 3:
            share = sum(b > a for a, b in zip(levels, levels[1:])) / (len(levels) - 1)
            if share >= v.ESCALATION_SHARE:
                return "escalation", share, "warn"
    for kind, count, threshold in (
        ("repeated_injection", sum(h[2] for h in history) if injected is None else injected, limits.injection_threshold),
        ("volume_abuse", len(history), limits.volume_threshold),
    ):
        if count >= threshold:
            return kind, min(count / (2 * threshold), 1.0), "block" if count >= 2 * threshold else "throttle"
    return None, 0.0, "allow"


def _risk(n: int, counts: list[int]) -> float:
    if not n:
        return 0.0
    injected, toxic, blocked = (c / n * w for c, w in zip(counts, v.RISK_WEIGHTS))
    return min(injected + toxic + blocked, 1.0)  # plain additions: sum() would round differently


class BehaviorProcessor(StatefulProcessor):
    def __init__(self, limits: Limits) -> None:
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getListState("history", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        width, most = self.limits.seconds * SECOND, self.limits.max_rows
        history = [tuple(h) for h in self.past.get()]
        had_history = bool(history)
        counts = [sum(h[i] for h in history) for i in (2, 3, 4)]
        in_order = all(a[1] <= b[1] for a, b in zip(history, history[1:]))
        out = []
        fresh = chain.from_iterable(zip(*(part[c].tolist() for c in ROW)) for part in rows)
        for at, event_id, injected, toxic, blocked, confidence, attempt, is_reset in sorted(fresh, key=itemgetter(0, 1)):
            if is_reset:
                history, counts, in_order = [], [0, 0, 0], True
                continue
            in_order = in_order and (not history or history[-1][1] <= at)
            history.append((event_id, at, injected, toxic, blocked, confidence, attempt))
            if in_order:  # what leaves is at the beginning, so counts follow it
                counts = [counts[0] + injected, counts[1] + toxic, counts[2] + blocked]
                gone = max(0, len(history) - most)
                while history[gone][1] < at - width:
                    gone += 1
                if gone:
                    for h in history[:gone]:
                        counts = [counts[0] - h[2], counts[1] - h[3], counts[2] - h[4]]
                    del history[:gone]
            else:
                history = [h for h in history[-most:] if h[1] >= at - width]
                counts = [sum(h[i] for h in history) for i in (2, 3, 4)]
            kind, sure, action = judge(history, self.limits, counts[0])
            out.append((key[0], event_id, at, len(history), *counts, _risk(len(history), counts), kind is not None, kind, sure, action))
        if had_history:  # a user without one has no timer either
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if history:
            self.past.put(history)
            self.handle.registerTimer((history[-1][1] + width) // 1000 + 1)
        elif had_history:
            self.past.clear()
        if out:
            yield pd.DataFrame(dict(zip(COLUMNS, map(list, zip(*out)))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.past.clear()
        return iter(())  # a frame for every user, even an empty one, would travel to the JVM as a batch of its own

    def close(self) -> None:
        pass


def detect(events: DataFrame, limits: Limits = Limits(), delay: str = "10 minutes") -> DataFrame:
    """Abuse findings per event of a stream; an optional boolean column ``is_reset`` clears a user's history."""
    reset = F.coalesce(F.col("is_reset"), F.lit(False)) if "is_reset" in events.columns else F.lit(False)
    rows = events.withWatermark("ts", delay).select(
        "user_id", "event_id", "ts", micros(F.col("ts")).alias("at"), reset.alias("is_reset"),
        *(F.coalesce(f"was_{f}", F.lit(False)).alias(f"was_{f}") for f in ("injection", "toxic", "blocked")),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.when(F.col("was_injection"), attempt_of(F.col("text"))).alias("attempt"))
    found = rows.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=BehaviorProcessor(limits), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
    return found.withColumn("ts", F.timestamp_micros("at")).drop("at")


def start(events: DataFrame, path: str, checkpoint: str, limits: Limits = Limits(), delay_seconds: float = 600, **trigger):
    """Abuse findings of a stream through the batch operators (``micro_batches``), written under ``path``.

    Unlike ``detect`` it takes any number of rows of one user in a micro-batch, and sets late rows apart instead of
    losing them.  The state is the histories: per user at most as many rows as a history has, and none too old for one.
    """
    flags = (F.coalesce(f"was_{f}", F.lit(False)).alias(f"was_{f}") for f in FLAGS)
    reset = F.coalesce(F.col("is_reset"), F.lit(False)) if "is_reset" in events.columns else F.lit(False)
    rows = events.select(
        "user_id", "event_id", "ts", micros(F.col("ts")).alias("at"), *flags, F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.when(F.col("was_injection"), attempt_of(F.col("text"))).alias("attempt"), reset.alias("is_reset"))
    most = max(limits.max_rows, limits.escalation_window, v.JAILBREAK_ROWS)

    def judge(fresh: DataFrame, before: DataFrame | None, newest: int) -> tuple[DataFrame, DataFrame]:
        known = fresh.withColumn("__new", F.lit(True))
        if before is not None:
            known = known.unionByName(before.select(*fresh.columns).withColumn("__new", F.lit(False)))
        # A reset begins a history of its own, as if of another user.
        numbered = running_sums(known, ["user_id"], ["at", "event_id"], None, {"__epoch": F.col("is_reset").cast("int")})
        of_epoch = numbered.where("not is_reset").withColumn("user_id", F.struct("user_id", "__epoch"))
        found = behavior.detect(of_epoch.drop("__new"), limits)
        new = of_epoch.where("__new").select(F.col("user_id").alias("__user"), F.col("event_id").alias("__event"), F.col("at").alias("__at"))
        same = found["user_id"].eqNullSafe(new["__user"]) & (found["event_id"] == new["__event"]) & (micros(found["ts"]) == new["__at"])
        judged = found.join(new, same, "left_semi").withColumn("user_id", F.col("user_id.user_id"))
        newest_first = Window.partitionBy("user_id").orderBy(F.col("__epoch").desc(), F.col("at").desc(), F.col("event_id").desc())
        young = F.col("at") >= F.lit(newest - int((limits.seconds + delay_seconds) * SECOND))
        kept = numbered.where(young).withColumn("__n", F.row_number().over(newest_first)).where(F.col("__n") <= most)
        return judged, kept.select(*fresh.columns, F.struct("at", "event_id").alias("clock"))

    return micro_batches.start(rows, judge, path, checkpoint, delay_seconds, **trigger)
