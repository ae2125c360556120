"""N-gram Jaccard join, components and benchmark decontamination against brute force."""

import itertools
import random

import pytest

from quietgate.llm import decontamination, ngram_join
from quietgate.llm.components import components
from quietgate.llm.ngram_join import ngram_components


def words(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ")


def grams(text, size):
    ws = [w for w in words(text) if w]
    return {tuple(ws)} if 0 < len(ws) < size else {tuple(ws[i:i + size]) for i in range(len(ws) - size + 1)}


def brute(rows, size, num, den):
    sets = {k: grams(t, size) for k, t in rows if k is not None}
    group = {k: k for k in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        i = len(sets[a] & sets[b])
        if i and den * i >= num * (len(sets[a] | sets[b])):
            lo, hi = sorted((group[a], group[b]))
            group = {k: lo if g == hi else g for k, g in group.items()}
    return {k: (len(sets[k]), group[k]) for k in sets}


def family(chance, base, copies, edits):
    out = []
    for _ in range(copies):
        ws = list(base)
        for _ in range(chance.randint(0, edits)):
            ws[chance.randrange(len(ws))] = f"new{chance.randrange(10**6)}"
        out.append(" ".join(ws))
    return out


def corpus(seed):
    chance = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    line = " ".join(chance.choices(vocabulary, k=12))
    texts = [" ".join(chance.choices(vocabulary, k=chance.choice((0, 1, 2, 4, 9, 40, 120)))) for _ in range(40)]
    for n in (60, 150):
        texts += family(chance, chance.choices(vocabulary, k=n), 25, 4)
    texts += [t + " " + line for t in texts[:10]] + texts[45:50] + [texts[50].upper(), "", None, " \n\t ", "a", "a", "a b", "x" * 5000]
    rows = list(enumerate(texts, 3))
    chance.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "num", "seed"), [(3, 90, 1), (5, 80, 2)])
def test_components_equal_brute_force(documents, size, num, seed):
    rows = corpus(seed)
    got = {r[0]: (r[1], r[2]) for r in ngram_components(documents(*rows, (None, rows[0][1])), size=size, numerator=num).collect()}
    assert got.pop(None)[1] is None
    assert got == brute(rows, size, num, 100)


def test_join_of_few_or_no_rows(documents):
    assert ngram_components(documents((1, "a")).where("doc_id > 1")).count() == 0
    rows = ngram_components(documents((1, "a b c d e f"), (1, "a b c d e f"), (2, None))).collect()
    assert sorted(map(tuple, rows)) == [(1, 2, 1), (1, 2, 1), (2, 0, 2)]


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    want = {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 200: 200, 300: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def item_text(chance, n):
    return " ".join(f"b{chance.randrange(4000)}" for _ in range(n))


def plain_similarity(a, b):
    x, y = grams(a, 5), grams(b, 5)
    return len(x & y) / len(x | y)


def test_passages_and_near_passages_are_found_and_clean_texts_left_alone(spark, documents):
    chance = random.Random(4)
    items = [(i, item_text(chance, chance.choice((15, 30, 45, 70)))) for i in range(30)]
    filler = lambda n: " ".join(f"f{chance.randrange(500)}" for _ in range(n))
    rows, want = [], {}
    for d in range(120):
        i, text = items[d % 30]
        ws = text.split()
        kind = d % 6
        if kind == 1:
            ws[-1:] = ["other"]
        if kind == 2:
            ws = ws[1:]
        if kind == 3:
            ws = [w.upper() + "," for w in ws]
        if kind == 4:
            ws = ws[:len(ws) // 2]
        passage = " ".join(ws)
        before = d % 50
        rows.append((d, (filler(before) + " " + passage + " " + filler(d % 40)).strip() if kind != 5 else filler(80)))
        if kind < 4:
            want[d, i] = before
    rows += [(500, items[3][1]), (501, None), (502, ""), (503, "b1"), (None, items[4][1])] + rows[:1]
    bench = spark.createDataFrame([*items, (77, "too short here"), (78, None), (None, items[0][1])], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.matches(documents(*rows), bench).collect()}
    # The item without an id has the text of item 0 and is found wherever that one is.
    want.update({(d, None): at for (d, i), at in want.items() if i == 0})
    assert {(d, i) for d, i in want} | {(500, 3), (None, 4)} == set(got)
    for (d, i), r in got.items():
        assert r["similarity"] >= 0.8
        if (d, i) in want:
            assert abs(r["start"] - want[d, i]) <= 1 and r["n_words"] <= 70
    assert got[500, 3]["similarity"] == pytest.approx(1) and got[0, 0]["similarity"] == pytest.approx(1)
    kept = {r[0] for r in decontamination.decontaminated(documents(*rows), bench).select("doc_id").collect()}
    assert kept == {None, 501, 502, 503} | {d for d, _ in rows if d is not None and d < 120 and d % 6 in (4, 5)}


def test_item_index_in_several_blocks_gives_the_same(spark, documents, monkeypatch):
    chance = random.Random(9)
    items = [(i, item_text(chance, 30)) for i in range(12)]
    rows = [(i, item_text(chance, 10) + " " + t) for i, t in items]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(map(tuple, decontamination.matches(documents(*rows), bench).collect()))
    monkeypatch.setattr(decontamination, "SEED_ROWS", 20)
    assert sorted(map(tuple, decontamination.matches(documents(*rows), bench).collect())) == whole and len(whole) == 12


def test_nothing_to_compare(spark, documents):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.matches(documents((1, "a b c d e f g")), bench).count() == 0
    full = spark.createDataFrame([(1, "a b c d e f g")], "item_id bigint, text string")
    assert decontamination.matches(documents((1, "a")).where("doc_id > 1"), full).count() == 0


def test_fingerprints_within_the_radius_share_a_looked_up_block(spark):
    chance = random.Random(2)
    prints = []
    for i in range(40):
        fp = chance.getrandbits(64)
        other = fp
        for bit in chance.sample(range(64), decontamination.RADIUS):
            other ^= 1 << bit
        prints.append((i, fp - (1 << 64) * (fp >> 63), other - (1 << 64) * (other >> 63)))
    df = spark.createDataFrame(prints, "key int, a bigint, b bigint")
    ours = decontamination._looked_up(df.selectExpr("key", "a as fp"), 1)
    theirs = decontamination._looked_up(df.selectExpr("key", "b as fp"), 2)
    assert ours.join(theirs, ["key", "block", "value"]).select("key").distinct().count() == 40
    far = theirs.withColumn("key", (theirs["key"] + 1) % 40)  # unrelated fingerprints hardly ever share one of 5 * 1288 values
    assert ours.join(far, ["key", "block", "value"]).select("key").distinct().count() < 25
    assert ours.groupBy("key").count().where("count <> 69").isEmpty() and ours.agg({"value": "max"}).first()[0] < 1 << 13


@pytest.mark.parametrize("members", [4096, 5])
def test_all_links_inside_groups_equal_brute_force(documents, monkeypatch, members):
    monkeypatch.setattr(ngram_join, "MEMBERS", members)
    rows = corpus(1)
    sets = {k: grams(t, 3) for k, t in rows}
    least = {k: min(j for j in sets if sets[j] == sets[k]) for k in sets}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2)
             if (i := len(sets[a] & sets[b])) and 100 * i >= 90 * len(sets[a] | sets[b])]
    pairs, counts = ngram_join.ngram_links(documents(*rows, (None, rows[0][1])), size=3, numerator=90)
    want = {tuple(sorted((least[a], least[b]))) for a, b in links if least[a] != least[b]}
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(want) and set(got) == want
    found = {r["doc_id"]: r["n_links"] for r in counts.collect()}
    assert found.pop(None) is None and found == {k: sum(k in x for x in links) for k in sets}
    assert sum(found.values()) > 2 * len(found)  # more than what connects the groups


def test_items_that_share_an_id_and_items_without_one(documents, spark):
    chance = random.Random(9)
    texts = [item_text(chance, 30) for _ in range(4)]
    items = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3])], "item_id bigint, text string")
    rows = [*((i, "before it " + t + " behind it") for i, t in enumerate(texts)), (9, "nothing of the kind in these few words")]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.matches(documents(*rows), items).collect()}
    assert got == {(0, 1), (1, 1), (2, None), (3, None)}
    assert [r["doc_id"] for r in decontamination.decontaminated(documents(*rows), items).collect()] == [9]
