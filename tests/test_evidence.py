"""Outputs against what was said before: contexts in rows and conversations in pieces give the same results."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quietgate import fixed_values as v
from quietgate.functions.text import places
from quietgate.operators import grounding, validation
from quietgate.plans import evidence, scan
from quietgate.plans.pairing import pair_turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def conversations(seed=1):
    dice = random.Random(seed)
    words = ["alpha", "anan", "ananan", "beta", "Größe", "İstanbul", "x", "gamma_1", "deltadelta", "ΣΊΣΥΦΟΣ", "2024", "the", "longish" * 12]
    rows = []
    for conv, count in ((1, 40), (2, 9), (None, 6), (3, 1), (4, 30)):
        for turn in range(count):
            said = " ".join(dice.choices(words, k=dice.choice([0, 1, 2, 12, 60 if conv == 1 else 5])))
            said = said.replace(" beta", ". Beta\nis", 1).replace("x alpha", "x\nalpha") + dice.choice(["", ".", "!\n", " ?"])
            if conv == 4:  # strings that reach over many turns of a letter or none
                said = dice.choice(["a", "b", "", "ab", "a b"])
            rows.append((conv, turn * 3, "assistant" if turn % 2 else "user", None if dice.random() < 0.06 else said))
    return rows


def outputs_of(turns):
    """Every turn as an output: its own text, or earlier words in another order."""
    made = "The alpha\na\nb\na\nb\na\nb\na was anan of deltadelta. Is beta\nis alpha gamma ananan? The İSTANBUL größe x 2024 longish."
    return turns.select("conv_id", "turn", F.lit("prompt words alpha").alias("prompt"), F.when(
        (F.col("turn") % 2 == 0) & (F.col("turn") > 3), F.lit(made)).otherwise(F.col("text")).alias("output"))


def context_before(rows, conv, turn):
    said = [r[3] for r in sorted(rows, key=lambda r: r[1]) if r[0] == conv and r[1] < turn and r[3] is not None]
    return "\n".join(said) if said else None


@pytest.mark.parametrize("most", [0, 60, 10 ** 9])
def test_contexts_and_pieces_agree(spark, monkeypatch, most):
    monkeypatch.setattr(evidence, "PIECE_CHARS", 512 if most else 250)
    rows = conversations()
    turns = spark.createDataFrame(rows, SCHEMA)
    outputs = outputs_of(turns).where("conv_id is not null")
    listed = spark.createDataFrame(
        [(c, t, context_before(rows, c, t)) for c, t in {(r[0], r[1]) for r in rows if r[0] is not None}],
        "conv_id bigint, turn bigint, context string")
    whole = outputs.join(listed, ["conv_id", "turn"])
    key = lambda r: (r["conv_id"], r["turn"], r["output"] or "")

    want = {key(r): r["verified"] for r in grounding.verify(whole.where("context is not null")).collect()}
    got = {key(r): r["verified"] for r in evidence.verify_turns(outputs, turns, most=most).collect()}
    assert got == want and any(c.supporting_context for r in want.values() if r for c in r)

    rowed, _ = evidence.with_earlier(outputs, turns, validation.items_of(F.col("output")), most)
    graded = lambda df, **more: {key(r): r["g"] for r in df.withColumn(
        "g", validation.grounding_of(F.col("output"), F.col("context"), **more)).collect()}
    assert graded(rowed.where("context is not null or known is not null"), known=F.col("known")) == graded(whole.where("context is not null"))
    guarded = lambda df, **more: {key(r): r["guard"] for r in scan.guard_output(df, **more).collect()}
    assert guarded(rowed, known="known") == guarded(whole)


def test_every_occurrence_is_found(spark, monkeypatch):
    monkeypatch.setattr(evidence, "PIECE_CHARS", 16)
    monkeypatch.setattr(evidence, "LOOK_AHEAD", 9)
    rows = conversations(2)
    placed = evidence._placed(spark.createDataFrame(rows, SCHEMA)).where("text is not null and conv_id is not null")
    items = ["a", "an", "anan", "beta", "a\nb", "b\na\nb", "\n", "x\nalpha", "longish" * 12, "deltadelta", "nowhere", "größe", "gamma_1 "]
    wanted = spark.createDataFrame([(c, i) for c in (1, 2, 3, 4) for i in items], "conv_id bigint, item string")
    got = {(r[0], r[1], r[2]) for r in evidence.occurrences(wanted, placed).collect()}
    joined = {c: placed.where(F.col("conv_id") == c).orderBy("turn").select(F.lower("text")).collect() for c in (1, 2, 3, 4)}
    want = set()
    for c, parts in joined.items():
        whole = "".join(p[0] + "\n" for p in parts)
        want |= {(c, i, at) for i in items for at in range(len(whole)) if whole.startswith(i, at)}
    assert got == want


def test_places_of_a_word(texts):
    df = texts("ananan", "xanan an", "", "nan", "a" * 400)
    got = [r[0] for r in df.orderBy("id").select(places(F.col("text"), F.lit("an"))).collect()]
    assert got == [[0, 2, 4], [1, 3, 6], [], [1], []]
    overlapping = [r[0] for r in df.orderBy("id").select(places(F.col("text"), F.lit("anan"))).collect()]
    assert overlapping == [[0, 2], [1], [], [], []]
    assert df.where("id = 4").select(places(F.col("text"), F.lit("aa"))).first()[0] == list(range(399))


def test_snippets_equal_a_plain_search(spark):
    dice = random.Random(8)
    words = [f"{a}{b}" for a in ("ka", "kaka", "lo", "mi") for b in ("", "ka", "lo")]
    rows = []
    for i in range(40):
        context = " ".join(dice.choices(words, k=dice.choice([3, 90, 300])))
        rows.append((i, context, " ".join(dice.choices(words, k=6)) + "."))
    df = spark.createDataFrame(rows, "id bigint, context string, output string")
    for r in grounding.verify(df).collect():
        for c in r["verified"]:
            asked, best, spot = c.claim.lower().rstrip(".").split(), 0, None
            for at in range(0, max(1, len(r["context"]) - v.SNIPPET_CHARS), v.SNIPPET_STEP):
                hits = sum(w in r["context"][at:at + v.SNIPPET_CHARS] for w in asked)
                if hits > best:
                    best, spot = hits, at
            want = r["context"][spot:spot + v.SNIPPET_CHARS].strip() if spot is not None and c.confidence >= v.CLAIM_SUPPORT else None
            assert c.supporting_context == want


def test_a_conversation_of_20_000_turns(spark):
    """No context is gathered: the time stays linear in the turns, and rows hold pieces."""
    dice = random.Random(3)
    words = [f"{a}{b}" for a in ("sto", "bri", "flam", "quo", "dre", "plin") for b in ("", "ter", "nox", "vane", "mish", "lorn", "pex")]
    rows = [(1, t, "assistant" if t % 2 else "user", " ".join(dice.choices(words, k=6)) + f" n{dice.randrange(3000)}x.") for t in range(20_000)]
    turns = spark.createDataFrame(rows, SCHEMA)
    outputs = pair_turns(turns)
    start = time.perf_counter()
    told, placed = evidence.with_earlier(outputs, turns, validation.items_of(F.col("output")))
    graded = told.withColumn("g", validation.grounding_of(F.col("output"), F.col("context"), known=F.col("known")))
    found = {r["turn"]: r for r in graded.collect()}
    assert placed is not None and len(found) == 10_000 and time.perf_counter() - start < 120
    far = [r for r in found.values() if r["known"] is not None]
    assert len(far) > 9000 and max(len(r["context"] or "") for r in found.values()) <= evidence.CONTEXT_CHARS
    ends, low = [], 0
    for r in rows:
        ends.append(low)
        low += len(r[3]) + 1
    whole = "\n".join(r[3] for r in rows)
    for turn in dice.sample(sorted(found), 60):
        said = whole[:max(ends[turn] - 1, 0)]
        asked = {w for w in found[turn]["output"].rstrip(".").split() if len(w) >= 4}
        inside = [w for w in asked if w in said]
        share = len(inside) / len(asked)
        assert found[turn]["g"].ungrounded == (share < v.GROUNDING_THRESHOLD)
        if found[turn]["known"] is not None:
            assert asked.intersection(found[turn]["known"]) == set(inside)
