"""Results that must not depend on the order of rows, the length of texts, or a second try."""

import re
import time

import pytest
from pyspark.sql import functions as F

from checks import queries
from quietgate.functions.text import number_text, spans
from quietgate.operators import encoding, pii, policy, redaction
from quietgate.plans import scan
from quietgate.sources import audit_sink
from tests.conftest import column


def test_means_do_not_depend_on_the_order_of_the_rows(spark):
    rows = [("s", ("allow", x, y)) for x, y in [(0.1, 0.7), (0.2, None), (0.3, 0.1), (1e-9, 0.2), (0.6, 0.35)] * 300]
    df = spark.createDataFrame(rows, "source string, scan struct<action:string,injection_score:double,toxicity_score:double>")
    found = {tuple(scan.corpus_report(df.repartition(n), ["source"]).first()) for n in (1, 3, 7, 16)}
    assert found == {("s", "allow", 1500, 360.0000003 / 1500, 405.0 / 1200)}


@pytest.mark.parametrize("value", [0.0, -0.0, 1.0, 0.35, 1e-5, 1.5e-5, 1e-4, 0.00123, 123456789.0, 1.5e7, 1e15, 1.25e15, 1e16, 1.5e300,
                                   -2.5e-7, 0.30000000000000004, 9999999.0, 1e7, 12345678.9, float("inf"), float("-inf"), float("nan")])
def test_numbers_are_written_as_python_writes_them(spark, value):
    assert spark.createDataFrame([(value,)], "x double").select(number_text(F.col("x"))).first()[0] == repr(value)


def test_threshold_rule_shows_the_score(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, "a", 0.35), (2, "a", 1e-05), (3, "a", None), (4, None, 1.0)], "id bigint, text string, s double")
    found = column(policy.evaluate(df, [policy.Policy("p", (policy.Rule("threshold", "score", threshold=0.0),))], score="s"), "policy")
    assert [f and f.violations[0].matched_text for f in found] == ["score=1.0", "score=0.35", "score=1e-05", "score=0.0", None]


def test_a_rule_over_batches_takes_nulls(spark):
    def judge(texts, scores):
        assert texts.notna().all() and scores.notna().all()
        return texts.where(texts.str.len() + scores > 4).str.upper()

    rule = policy.Rule("custom", "long", batch=judge)
    df = spark.createDataFrame([(0, "long one", 0.0), (1, "abc", 2.0), (2, "abc", None), (3, None, 9.0), (4, "", 9.0)], "id bigint, text string, s double")
    rules = [policy.Policy("p", (policy.Rule("keyword", "word", keywords=("one",)), rule))]
    found = column(policy.evaluate(df, rules, score="s"), "policy")
    assert [f and [x.matched_text for x in f.violations] for f in found] == [["one", "LONG ONE"], ["ABC"], [], None, [""]]
    assert column(policy.evaluate(df, rules), "policy.passed") == [False, True, True, None, True]
    nothing = spark.createDataFrame([(0, None, None)], df.schema)
    assert column(policy.evaluate(nothing, rules, score="s"), "policy") == [None]


def test_scripts_are_looked_up_for_every_character(texts):
    df = texts("abc", "漢字 mixed текст বাংলা", "𝐀 𐍈", "é×÷", "1 2 ‮", "", "ａＢ", None)
    got = column(encoding.unicode_counts(df), "scripts")
    want = []
    for text in ("abc", "漢字 mixed текст বাংলা", "𝐀 𐍈", "é×÷", "1 2 ‮", "", "ａＢ"):
        import unicodedata
        want.append(sorted({unicodedata.name(c).split()[0] for c in text if c.isalpha()}))
    assert got[:-1] == want and got[-1] is None
    plan = encoding.unicode_counts(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") < 10


def test_disguise_is_counted_without_the_ascii_characters(texts):
    """Classes of many characters are not tried on every character of a text."""
    hidden = "a\u200bb\u00adc \u202e\u0430\u0435 z" * 3
    df = texts(hidden, "plain", "", None, "über Ŀ Ẁ Ⅷ ªº µ")
    counted = encoding.unicode_counts(df)
    rows = counted.collect()
    assert [(r.homoglyphs, r.invisibles, r.right_to_left) for r in rows] == [(6, 6, 3), (0, 0, 0), (0, 0, 0), (None,) * 3, (0, 0, 0)]
    assert rows[0].homoglyph_codes == "U+0430, U+0435, U+0430, U+0435, U+0430" and rows[0].invisible_codes.startswith("U+200B, U+00AD, ")
    assert rows[4].scripts == ["FEMININE", "LATIN", "MASCULINE", "MICRO"]
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"regexp_(count|extract_all)\(text#", plan)


def test_a_rule_of_several_policies_is_tested_once(texts):
    df = texts("call 555-123-4567 bomb", "a bomb", "nothing", "", None)
    shared, word = policy.Rule("regex", "number", r"\b\d{3}-\d{4}\b"), policy.Rule("keyword", "word", keywords=("Bomb",))
    rules = [policy.Policy(f"p{i}", (policy.Rule("regex", f"number {i}", shared.pattern), word)) for i in range(6)]
    rules += [policy.Policy("number", (shared,)), policy.Policy("off", (word,), enabled=False), policy.Policy("none", ())]
    found = policy.names_hit(df, rules)
    six = [f"p{i}" for i in range(6)]
    assert column(found, "hit") == [[*six, "number"], six, [], [], []]
    listed = {p.name: [bool(x) for x in column(policy.evaluate(df, [p]), "policy.violations")] for p in rules}
    assert {name: [name in hit for hit in column(found, "hit")] for name in listed} == listed
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\\d{3}-\\d{4}") <= 2  # one test, one extraction


def test_texts_are_searched_once_for_all_strategies(spark, tmp_path, monkeypatch):
    rows = [(i, "s", "en", f"mail a{i}@b.co or 10.0.0.{i} " * 2) for i in range(5)] + [(9, "s", "en", None), (10, "s", "en", "")]
    spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    detected = []
    monkeypatch.setattr(pii, "detect", lambda df, *a, run=pii.detect, **k: detected.append(1) or run(df, *a, **k))
    found = queries.pii_reverse_placed(spark, str(tmp_path))
    assert sorted((r.doc_id, r.strategy, r.same) for r in found.collect()) == sorted(
        (i, s, True if t is not None else None) for i, _, _, t in rows for s in ("hash", "anonymize"))
    assert len(detected) == 1
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_the_text_around_matches_is_split_once(texts):
    """Not once more for every block of 128 matches; and base64 is placed only where a run is readable."""
    df = texts("x " + "aGVsbG8gdGhlcmUsIGdlbmVyYWw= und " * 300 + "Donaudampfschifffahrtsgesellschaft", "Rechtsschutzversicherungsgesellschaft", None)
    plan = df.select(spans(F.col("text"), "[0-9]+").alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    found = column(df.withColumn("i", encoding.base64_items(F.col("text"))), "i")
    assert [(i.decoded, i.start) for i in found[0]] == [("hello there, general", 2 + 33 * n) for n in range(300)] and not found[1] and not found[2]
    assert "exists(regexp_extract_all(" in df.select(encoding.base64_items(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()


def test_many_hashed_entities_are_put_back_in_one_pass(spark):
    text = " ".join(f"user{i % 9000}@mail{i}.example.com," for i in range(16_000))
    df = spark.createDataFrame([(1, text), (2, "no data"), (3, None), (4, "a@b.co and a@b.co")], "id bigint, text string")
    start = time.perf_counter()
    for strategy in redaction.STRATEGIES:
        redacted = redaction.redact(df, strategy=strategy, entity_types=["EMAIL"])
        places = redaction.places_table(redacted, "id")
        restored = redaction.reverse_placed(redacted.select("id", "text", "redacted"), places, "id").collect()
        assert all(r.restored == r.text for r in restored)
        assert {r.id for r in restored if r.redacted != r.text} == {1, 4} and len(restored) == 4
    assert time.perf_counter() - start < 60


def test_overlapping_replacements_fall_back_to_their_map(spark):
    span = "array<struct<entity_type:string,text:string,start:int,end:int>>"
    df = spark.createDataFrame([(1, "abcdefgh", [("A", "abcd", 0, 4), ("B", "cdef", 2, 6)])], f"id bigint, text string, e {span}")
    redacted = redaction.redact_entities(df, "text", "e", "mask", "*")
    places = redaction.places_table(redacted, "id")
    assert [r.start for r in places.collect()] == [None, None]
    mapped = redaction.reverse(redacted, redaction.mapping_table(redacted, "id"), "id").first().restored
    assert redaction.reverse_placed(redacted, places, "id").first().restored == mapped


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    log = spark.range(1000).selectExpr("timestamp_seconds(id * 400) AS ts", "id AS correlation_id").repartition(16)
    path = str(tmp_path / "log")
    audit_sink.append(log, path, "first")
    audit_sink.append(log, path, "first")
    audit_sink.append(log.where("correlation_id < 10"), path)
    assert audit_sink.read(spark, path).count() == 1010
    days = {p.name: len(list(p.glob("batch=first/*.parquet"))) for p in (tmp_path / "log").glob("day=*")}
    assert len(days) == 5 and max(days.values()) <= 2  # not one file for each of 16 tasks


def test_a_micro_batch_run_again_adds_no_row(spark, tmp_path):
    schema = "ts timestamp, correlation_id bigint"
    spark.range(100).selectExpr("timestamp_seconds(id * 4000) AS ts", "id AS correlation_id").write.parquet(f"{tmp_path}/in")

    def run(checkpoint):
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        audit_sink.stream_append(stream, f"{tmp_path}/log", f"{tmp_path}/{checkpoint}").awaitTermination(120)
        return audit_sink.read(spark, f"{tmp_path}/log").count()

    assert run("a") == 100 and run("a") == 100
    assert run("lost") == 100  # a checkpoint that did not keep the batch: the same batch is written again
