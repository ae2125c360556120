"""Per-user behaviour: bounded history, risk score and abuse patterns as of every event.

Input: ``user_id, event_id, ts, text, was_injection, was_toxic, was_blocked, confidence``.
A history is the user's last ``max_rows`` events that are no older than ``seconds``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from quietgate import fixed_values as v
from quietgate.functions.running import micros, ranges, rank, running_sums, slice_of
from quietgate.functions.text import fenced, let, strip

SECOND = 1_000_000
FLAGS = ("injection", "toxic", "blocked")


@dataclass(frozen=True)
class Limits:
    max_rows: int = v.HISTORY_ROWS
    seconds: int = v.HISTORY_SECONDS
    injection_threshold: int = v.INJECTION_REPEATS
    volume_threshold: int = v.VOLUME_LIMIT
    escalation_window: int = v.ESCALATION_ROWS


def attempt_of(text: Column) -> Column:
    """Form in which two attempts count as the same."""
    return F.substring(strip(F.lower(text)), 1, v.JAILBREAK_CHARS)


CHUNK = 8192  # events of one user that share a window group


def history(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Add the history counts of every event (``n, n_injection, n_toxic, n_blocked``) and its last rows (``recent``).

    A history is never longer than ``max_rows`` events, so one frame of that many rows holds it; the first one young
    enough is found in it by binary search, and the counts are differences of running sums.  The cost is linear in the
    events, however many fall into one history length.  Busy users' events are numbered with counts carried over ranges
    and cut into chunks by number; the end of each chunk is copied into the next one, where later events look back at
    it.  So a busy user spreads over tasks.  Only narrow columns take part.  A column ``attempt`` holds the form of the
    text made before, instead of ``text``.
    """
    width = limits.seconds * SECOND
    last = max(limits.escalation_window, v.JAILBREAK_ROWS)
    flag = {f: F.coalesce(F.col(f"was_{f}"), F.lit(False)).cast("bigint") for f in FLAGS}
    attempt = F.col("attempt") if "attempt" in events.columns else F.when(F.col("was_injection"), attempt_of(F.col("text")))
    narrow = events.select(
        "user_id", "event_id", "ts", "was_injection", "was_toxic", "was_blocked", "confidence", attempt.alias("__attempt"),
        micros(F.col("ts")).alias("__at"))
    cut = ranges(narrow, ["user_id"], ["__at", "event_id"])
    own, keys, placed = F.lit(True), ["user_id"], cut.rows
    if cut.split:
        back = max(limits.max_rows, last) - 1
        chunk = max(CHUNK, back + 1)
        numbered = running_sums(narrow, ["user_id"], ["__at", "event_id"], cut, {"__no": F.lit(1)})
        at_end = F.pmod(F.col("__no") - 1, F.lit(chunk)) >= chunk - back
        placed = numbered.withColumn("__own", slice_of(F.col("__no") - 1, chunk)).select("*", F.explode(
            F.when(at_end, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))).alias("__chunk"))
        own, keys = F.col("__chunk") == F.col("__own"), ["user_id", "__chunk"]

    order = Window.partitionBy(*keys).orderBy("__at", "event_id")
    sums = {f: F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0)) for f, c in flag.items()}
    summed = placed.select("*", *(s.alias(f"__to_{f}") for f, s in sums.items()))
    before = F.struct(F.col("__at").alias("at"), *((F.col(f"__to_{f}") - c).alias(f) for f, c in flag.items()))
    row = F.struct(F.col("was_injection").alias("inj"), F.col("was_toxic").alias("tox"),
                   F.col("confidence").alias("conf"), F.col("__attempt").alias("attempt"))
    framed = summed.select("*", F.collect_list(before).over(order.rowsBetween(-(limits.max_rows - 1), 0)).alias("__seen"),
                           F.collect_list(row).over(order.rowsBetween(-(last - 1), 0)).alias("__last")).where(own)
    young = F.transform("__seen", lambda e: e["at"])
    older = fenced(framed.withColumn("__ats", young), "__older", rank(
        F.col("__ats"), F.col("__at") - width, limits.max_rows, strictly=True))
    since = F.get("__seen", F.col("__older"))
    sized = older.select(
        "user_id", "event_id", "ts", "was_injection", "was_toxic", "was_blocked", "confidence", "__last",
        (F.size("__seen") - F.col("__older")).cast("bigint").alias("n"),
        *((F.col(f"__to_{f}") - since[f]).alias(f"n_{f}") for f in FLAGS))
    kept_rows = F.least(F.size("__last"), F.col("n").cast("int"))
    return sized.withColumn("recent", F.slice("__last", F.size("__last") - kept_rows + 1, kept_rows)).drop("__last")


def risk_of(n: Column, injections: Column, toxics: Column, blocks: Column) -> Column:
    ratio = lambda c: c.cast("double") / n.cast("double")
    a, b, c = v.RISK_WEIGHTS
    return F.when(n > 0, F.least(
        ratio(injections) * F.lit(a) + ratio(toxics) * F.lit(b) + ratio(blocks) * F.lit(c), F.lit(1.0),
    )).otherwise(F.lit(0.0))


def with_risk(histories: DataFrame) -> DataFrame:
    return histories.withColumn("risk_score", risk_of(*(F.col(c) for c in ("n", "n_injection", "n_toxic", "n_blocked"))))


def risk_as_of(events: DataFrame, now: str, limits: Limits = Limits()) -> DataFrame:
    """Risk score per user at a given time; users without a history in the window score zero.

    Keeping the newest ``max_rows`` per user is a row-number filter, which Spark applies before the
    shuffle as well, so a user with many events sends only that many from each task.
    """
    at, moment = micros(F.col("ts")), micros(F.to_timestamp(F.lit(now)))
    seen = events.where(at <= moment).select("user_id", "event_id", "was_injection", "was_toxic", "was_blocked",
                                             at.alias("__at"))
    newest = Window.partitionBy("user_id").orderBy(F.col("__at").desc(), F.col("event_id").desc())
    ranked = seen.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= limits.max_rows)
    inside = F.col("__at") >= moment - limits.seconds * SECOND
    counts = ranked.groupBy("user_id").agg(
        F.count_if(inside).alias("n"),
        *(F.count_if(inside & F.col(f"was_{f}")).alias(f"n_{f}") for f in FLAGS))
    return with_risk(counts)


ABUSE_TYPE = "struct<abuse_type:string,confidence:double,action:string>"


def _finding(kind: str, confidence: Column, action: Column) -> Column:
    return F.struct(F.lit(kind).alias("abuse_type"), confidence.alias("confidence"), action.alias("action"))


def _tail(rows: Column, n: int) -> Column:
    return F.slice(rows, F.greatest(F.size(rows) - n + 1, F.lit(1)), F.lit(n))


def _counted(kind: str, count: Column, threshold: int) -> Column:
    """Count findings: throttle from the threshold on, block from twice the threshold on."""
    confidence = F.least(count.cast("double") / F.lit(float(threshold * 2)), F.lit(1.0))
    action = F.when(count >= threshold * 2, F.lit("block")).otherwise(F.lit("throttle"))
    return F.when(count >= threshold, _finding(kind, confidence, action))


def repeated_injection(limits: Limits) -> Column:
    return _counted("repeated_injection", F.col("n_injection"), limits.injection_threshold)


def volume(limits: Limits) -> Column:
    return _counted("volume_abuse", F.col("n"), limits.volume_threshold)


def escalation(limits: Limits) -> Column:
    """Rising confidences among the flagged ones of the last few requests."""
    flagged = F.transform(F.filter(_tail(F.col("recent"), limits.escalation_window), lambda r: r["inj"] | r["tox"]),
                          lambda r: r["conf"])

    def judge(levels: Column) -> Column:
        count = F.size(levels)
        steps = F.zip_with(F.slice(levels, 1, count - 1), F.slice(levels, 2, count - 1), lambda a, b: b > a)
        share = F.size(F.filter(steps, lambda up: up)).cast("double") / (count - 1).cast("double")
        return F.when((count >= 3) & (F.col("n") >= limits.escalation_window), let(share, lambda s: F.when(
            s >= F.lit(v.ESCALATION_SHARE), _finding("escalation", s, F.lit("warn")))))

    return let(flagged, judge)


def jailbreak() -> Column:
    """Many different injection attempts among the last requests."""
    attempts = F.transform(F.filter(_tail(F.col("recent"), v.JAILBREAK_ROWS), lambda r: r["inj"]), lambda r: r["attempt"])

    def judge(tried: Column) -> Column:
        share = F.size(F.array_distinct(tried)).cast("double") / F.size(tried).cast("double")
        return F.when((F.size(tried) >= v.JAILBREAK_HITS), let(share, lambda s: F.when(
            s >= F.lit(v.JAILBREAK_SHARE), _finding("jailbreak_sequence", F.least(s, F.lit(1.0)), F.lit("block")))))

    return let(attempts, judge)


CHECKS = {
    "jailbreak_sequence": lambda limits: jailbreak(),
    "escalation": escalation,
    "repeated_injection": repeated_injection,
    "volume_abuse": volume,
}


def detect_one(events: DataFrame, kind: str, limits: Limits = Limits()) -> DataFrame:
    """A single abuse check as of every event; null where it does not apply."""
    return history(events, limits).withColumn("abuse", CHECKS[kind](limits)).drop("recent")


def detect(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """First check that applies, most severe first, with the risk score."""
    first = F.coalesce(*(check(limits) for check in CHECKS.values()))
    found = with_risk(history(events, limits)).withColumn("__a", first).drop("recent")
    return found.select(
        "*",
        F.col("__a").isNotNull().alias("is_abusive"),
        F.col("__a.abuse_type").alias("abuse_type"),
        F.coalesce(F.col("__a.confidence"), F.lit(0.0)).alias("abuse_confidence"),
        F.coalesce(F.col("__a.action"), F.lit("allow")).alias("recommended_action"),
    ).drop("__a")
