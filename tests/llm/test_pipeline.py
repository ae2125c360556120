"""The pipeline's stages, one by one, on planted documents; its result over a given table."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_near_copies import brute, item_text

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def stage(spark, tmp_path):
    chance = random.Random(1)
    spark.createDataFrame([(i, item_text(chance, 30)) for i in range(5)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def run(name, rows):
        docs = spark.createDataFrame([(k, t, lang, "s", None if t is None else len(t)) for k, t, lang in rows], COLUMNS)
        made = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
        if name != "pack":
            assert made.columns == docs.columns
        return made
    run.folder = str(tmp_path)
    run.items = {i: item_text(c, 30) for c in [random.Random(1)] for i in range(5)}
    return run


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "redact", "pack"]


def test_language_keeps_clean_texts_only(stage):
    chance = random.Random(2)
    rows = [(i, " ".join(chance.choices(w, k=40)), lang) for i in range(60)
            for lang, w in [(("en", ["the", "sea", "and"]), ("de", ["größe", "über", "der"]))[i % 2]]]
    odd = [(100, None, "en"), (101, "", None), (102, "12 % 3", "en"), (None, "the sea and", None), (None, "", None)]
    kept = stage("language", rows + odd)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, i) for i in range(60)] + [(True, 0)]


def test_one_of_each_group_stays(stage):
    chance = random.Random(3)
    base = [f"w{chance.randrange(300)}" for _ in range(80)]
    rows = [(i, " ".join(base[:-1] + [f"x{i}"]), "en") for i in range(20, 30)] + [(1, "short", "en"), (2, "short", "en"), (5, None, "en"),
            (6, "", None), (7, "some other text of its own", "en"), (7, "some other text of its own", "en"), (None, "short", "en")]
    kept = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in stage("near_duplicates", rows).collect())
    want = brute([(k, t) for k, t, _ in rows], 5, 80, 100)
    assert kept == sorted([-1, *{k for k, (_, g) in want.items() if k == g}])


def test_benchmark_documents_go(stage):
    filler = "plain words that fill the text " * 4
    rows = [(i, filler + t + " " + filler, "en") for i, t in stage.items.items()] + [(50, filler, "en"), (51, None, None), (None, filler, "en")]
    assert sorted((r["doc_id"] or -1) for r in stage("decontaminate", rows).collect()) == [-1, 50, 51]


def test_personal_data_is_replaced(stage):
    rows = [(1, "to a.b@mail.example.com now", "en"), (2, "clean", "en"), (3, None, None)]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in stage("redact", rows).collect()}
    assert got == {1: ("to [EMAIL] now", 14), 2: ("clean", 5), 3: (None, None)}


def test_all_that_is_left_is_packed(stage):
    pieces = stage("pack", [(1, "word " * 700 + "end", "en"), (2, None, None), (None, "x", "en")])
    total = {r["doc_id"]: (r["t"], r["n"]) for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("t"), F.first("doc_tokens").alias("n")).collect()}
    assert all(t == n for t, n in total.values()) and total[2] == (1, 1) and set(total) == {1, 2, None}


def test_run_of_a_whole_table_and_of_an_empty_one(spark, tmp_path):
    made = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert made.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").isEmpty() and made.count() > 100
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_different_texts_under_one_id_stay(stage):
    chance = random.Random(5)
    text = lambda: " ".join(f"w{chance.randrange(900)}" for _ in range(40))
    a, b, c = text(), text(), text()
    rows = [(3, a, "en"), (7, a, "en"), (7, b, "en"), (7, b, "en"), (8, c, "en"), (8, None, "en"), (9, b, "en"), (None, a, "en")]
    kept = [(r["doc_id"] or -1, r["text"]) for r in stage("near_duplicates", rows).collect()]
    assert sorted(kept, key=str) == sorted([(3, a), (7, b), (8, c), (8, None), (-1, a)], key=str)


def test_language_judges_every_row_by_its_own_text(stage):
    chance = random.Random(2)
    rows = [(i, " ".join(chance.choices(w, k=40)), lang) for i in range(60)
            for lang, w in [(("en"), ["the", "sea", "and"]), ("de", ["größe", "über", "der"])][i % 2:i % 2 + 1]]
    clean = "the sea and the sea and the sea"
    odd = [(900, clean, "en"), (900, "12345 ---", "en"), (901, None, "en"), (901, clean, None), (None, clean, None), (None, "12 34", None),
           (902, clean, "en"), (902, clean, "en")]
    kept = [(r["doc_id"], r["text"]) for r in stage("language", rows + odd).collect() if r["doc_id"] is None or r["doc_id"] >= 900]
    assert sorted(kept, key=str) == sorted([(900, clean), (901, clean), (None, clean), (902, clean), (902, clean)], key=str)


def test_contaminated_rows_go_whatever_their_id(stage):
    filler = "plain words that fill the text " * 4
    bad = filler + stage.items[2] + " " + filler
    rows = [(901, bad, "en"), (901, filler, "en"), (None, bad, "en"), (None, filler, "en"), (5, bad, "en"), (5, bad, "en"), (6, filler, "en"),
            (6, filler, "en"), (7, None, "en"), (7, bad, "en")]
    kept = [(r["doc_id"], r["text"]) for r in stage("decontaminate", rows).collect()]
    assert sorted(kept, key=str) == sorted([(901, filler), (None, filler), (6, filler), (6, filler), (7, None)], key=str)


def test_empty_tables_stay_empty(spark, stage):
    for name, _ in corpus_pipeline.STAGES:
        docs = spark.createDataFrame([], COLUMNS)
        assert dict(corpus_pipeline.STAGES)[name](spark, docs, stage.folder).isEmpty()
