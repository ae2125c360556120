"""Language model, quality rules, personal data, language identification and quality classifier."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quietgate.llm import language_id, language_model, personal_data, quality_classifier, quality_rules
from quietgate.llm.common import held_out, word_hashes, words_of


def rows_of(df):
    return {r[0]: r.asDict() for r in df.collect()}


# --- language model ---

def lm_rows():
    chance = random.Random(3)
    ws = ["the", "Of", "and", "sea", "rock,", "é", "tide"]
    rows = [(i, " ".join(chance.choices(ws, weights=(9, 5, 5, 2, 2, 1, 1), k=chance.choice((0, 1, 8, 60))))) for i in range(80)]
    return [*rows, (100, None), (101, ""), (102, "never seen words"), (103, "the  of\tand\nsea"), (104, rows[7][1])]


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w] + [None]


@pytest.mark.parametrize("bytes_", [1 << 20, 700])
def test_scores_equal_a_plain_bigram_model(documents, monkeypatch, bytes_):
    monkeypatch.setattr(language_model, "BLOCK_BYTES", bytes_)
    monkeypatch.setattr(language_model, "SHARD_BYTES", bytes_ // 2)
    monkeypatch.setattr(language_model, "BUFFERED", 90)
    rows = [*lm_rows(), *((10_000 + i, "the sea and the rock " * 9) for i in range(0, 9000, 3000))]  # sparse keys: uneven ranges
    aside = {k for k, _ in rows if zlib.crc32(str(k).encode()) % 10 == 0}
    uni, bi = Counter(), Counter()
    for k, t in rows:
        if k not in aside:
            ts = tokens(t)
            uni.update(ts)
            bi.update(zip(["<s>", *ts], ts))
    starts, n, v = sum(k not in aside for k, _ in rows), sum(uni.values()), len(uni)
    kept = Counter()
    for (h, _), c in bi.items():
        kept[h] += c * (c >= language_model.LEAST)
    got = rows_of(language_model.scored(documents(*rows), held_out=held_out(F.col("doc_id"), 10, 0)))
    assert len(got) == len(rows)
    for k, t in rows:
        ts = tokens(t)
        base = [(uni[w] + 0.1) / (n + 0.1 * (v + 1)) for w in ts]
        total = 0
        for h, w, p in zip(["<s>", *ts], ts, base):
            c = starts if h == "<s>" else uni[h]
            rest = 1 - language_model.SHARE * kept[h] / max(c, 1)
            arc = language_model.SHARE * bi[h, w] / c if bi[h, w] >= language_model.LEAST else 0
            total += math.log10(arc + rest * p)
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (k in aside, len(ts), sum(uni[w] > 0 for w in ts), n)
        assert r["base_score"] == pytest.approx(sum(map(math.log10, base))) and r["score"] == pytest.approx(total)


@pytest.mark.parametrize("bytes_", [1 << 20, 700])
def test_scores_equal_a_plain_trigram_model_of_all_ngrams(documents, monkeypatch, bytes_):
    monkeypatch.setattr(language_model, "BLOCK_BYTES", bytes_)
    monkeypatch.setattr(language_model, "SHARD_BYTES", bytes_ // 2)
    monkeypatch.setattr(language_model, "BUFFERED", 90)
    rows = [*lm_rows(), (200, "once seen words"), (201, "twice seen words"), (202, "twice seen rock")]
    aside = {k for k, _ in rows if zlib.crc32(str(k).encode()) % 10 == 0}
    uni, grams = Counter(), {2: Counter(), 3: Counter()}
    for k, t in rows:
        if k not in aside:
            ts = ["<s>", *tokens(t)]
            uni.update(ts[1:])
            for size, table in grams.items():
                table.update(zip(*(ts[i:] for i in range(size))))
    n, v = sum(uni.values()), len(uni)
    uses, follow, discount = Counter(), Counter(), {}
    for size, table in grams.items():
        seen = Counter(table.values())
        discount[size] = seen[1] / (seen[1] + 2 * seen[2])
        for g, c in table.items():
            uses[g[:-1]] += c
            follow[g[:-1]] += 1

    def p(history, w):
        if not history:
            return (uni[w] + 0.1) / (n + 0.1 * (v + 1))
        below = p(history[1:], w)
        if not uses[history]:
            return below
        size = len(history) + 1
        d = discount[size]
        return (max(grams[size][(*history, w)] - d, 0) + d * follow[history] * below) / uses[history]

    got = rows_of(language_model.scored(documents(*rows), held_out=held_out(F.col("doc_id"), 10, 0), order=3))
    assert len(got) == len(rows)
    for k, t in rows:
        ts = ["<s>", *tokens(t)]
        want = sum(math.log10(p(tuple(ts[max(0, i - 2):i]), ts[i])) for i in range(1, len(ts)))
        assert got[k]["score"] == pytest.approx(want) and got[k]["n_tokens"] == len(ts) - 1
    assert sum(p(("the", "of"), w) for w in [*uni, "unknown"]) == pytest.approx(1)


def test_language_model_of_no_rows_and_null_keys(documents):
    assert language_model.scored(documents((1, "a")).where("doc_id > 1")).count() == 0
    rows = language_model.scored(documents((None, "a b"), (1, "a b"), (1, "a b"))).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in rows) == [(0, 3), (1, 3), (1, 3)]


def test_tokens_are_the_words_between_the_same_signs():
    chance = random.Random(4)
    texts = [None, "", " ", "a", "\tA  b\n", *("".join(chance.choices("aZé \t\n\x0b\x0c\r\x1c\x1f\x85\xa0\u2003\0", k=40)) for _ in range(300))]
    found = [language_model.tokens(pa.array(texts).slice(at, 100)) for at in range(0, len(texts), 100)]
    made, sizes = (np.concatenate(x) for x in zip(*found))
    for t, own in zip(texts, np.split(made, np.cumsum(sizes)[:-1])):
        assert own.tolist() == [language_model.START, *word_hashes(words_of(t and t.encode())).tolist(), language_model.END]


def test_ngrams_of_a_block_cost_few_bytes():
    chance = random.Random(5)
    texts = pa.array([" ".join(f"w{int(chance.paretovariate(0.6))}" for _ in range(400)) for _ in range(500)])
    docs = pa.record_batch({"block": np.zeros(len(texts), np.int64), "held_out": pa.array([False] * len(texts)), "text": texts})
    rows = [r for made in (language_model._counting(1, (1, 2)), language_model._counting(1, (3,))) for b in made([docs]) for r in b.to_pylist()]
    grams = language_model.Grams(language_model.tokens(texts)[0], 1, (1, 2, 3))
    items, size = sum(len(k[0]) for k in grams.kinds.values()), sum(len(r[c]) for r in rows for c in "arbn")
    assert size < 8.5 * items  # 14 before
    answers = [r for shard in (2, 3) for r in language_model._merged(1, 3)(pa.Table.from_pylist(
        [r for r in rows if r["shard"] == shard], language_model._PACK)).to_pylist()]
    totals = np.concatenate([language_model._numbers(r["n"]) for r in answers if r["shard"] == -5])
    assert totals.sum() == len(texts) * 400 and len(totals) == len(grams.kinds[3][0])
    assert sum(len(r[c] or b"") for r in answers for c in "arbn") < 1.5 * len(totals)  # 7 and 8 more for every history before


def test_trigram_model_of_no_rows(documents):
    assert language_model.scored(documents((1, "a")).where("doc_id > 1"), order=3).count() == 0


# --- quality rules ---

def plain_counts(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(ws[i:i + 8]) for i in range(len(ws) - 7))
    covered = {j for i in range(len(ws) - 7) if windows[tuple(ws[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_equal_brute_force(spark):
    chance = random.Random(8)
    some = [" ".join(chance.choices(["a", "bé", "c#", "dd", "\n", "e\t", "𝔸"], k=chance.choice((3, 10, 40, 200)))) for _ in range(60)]
    texts = [*some, "x y " * 40, "one line here\n" * 9, "", None, " \n ", "w " * 3000, "z" * 9000, "a b c d e f g h " * 2]
    df = spark.createDataFrame([(i, t, "h", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, source string, words int")
    got = rows_of(quality_rules.measured(df))
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_counts(t), t


def test_hosts_are_shrunk_and_verdicts_joined_back(spark):
    chance = random.Random(1)
    good = lambda: " ".join(f"word{chance.randrange(500)}" for _ in range(40))
    bad = "x## y%% z&& " * 20
    rows = [(i, good(), "fine") for i in range(300)] + [(1000 + i, bad if i % 10 else good(), "junk") for i in range(60)]
    rows += [(2000, bad, "tiny"), (2001, good(), "new"), (2002, good(), None), (2003, None, "fine")] + [(3000 + i, good(), f"h{i}") for i in range(30)]
    got = rows_of(quality_rules.judged(spark.createDataFrame(rows, "doc_id bigint, text string, source string")))
    assert len(got) == len(rows)
    assert all(got[i]["kept"] for i in range(300)) and got[2001]["kept"] and got[2002]["kept"]
    assert not any(got[1000 + i]["kept"] for i in range(60)) and got[1000]["host_rejected"]
    assert got[2003]["base_failed"] and not got[2003]["kept"]
    assert got[2000]["worst_rate"] < 1 and got[2000]["base_failed"]
    assert quality_rules.judged(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0


# --- personal data ---

PII = [
    "mail x.y+z@mail.example.com and a@b.c_d@e.f, bad a@b, a@b..c.d q@w.e.",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 007.010.1.255 1.2.3 9999999999.1.1.1 1.1.1.1é",
    "4111 1111 1111 1111 4111-1111-1111-1112 378282246310005 1234 card 6011000990139424 0000000000000000",
    "+1 (456) 555-2186 +49 30 1234567, +12 +1-234-567-890-123-456 +1 (456) 555-2186 4111111111111111",
    "+4111111111111111 ++1 2345678901 +1 ((((", "é" * 50 + "ü a@b.de", "", None, "9" * 20000, "a" * 30000 + "@", "1 " * 9000,
    "+" + "1 (" * 5000, "a.b" * 4000 + "@x.yz", "@" * 3000,
]


def luhn(digits):
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in twice) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate((
            ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+" if len(text) > 1000 else
             r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)" if len(text) < 1000 else r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return sorted(out)


def test_base_spans_equal_the_patterns(documents):
    chance = random.Random(5)
    parts = ["+1 ", "(456) ", "555-", "2186", "a@b.co", "@", ".", "4111", " ", "1.2.3.4", "é", "-", "_", "10", "x", "0", "00.255.", "256"]
    texts = PII + ["".join(chance.choices(parts, k=chance.randrange(1, 30))) for _ in range(300)]
    got = rows_of(personal_data.detect(documents(*enumerate(texts))))
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(w[2] for w in want).encode()).hexdigest(), (t or "")[:80]
        assert [got[i][f"n_{k}"] for k in personal_data.KINDS] == [sum(w[1] == k for w in want) for k in range(4)]
        assert {w[2] for w in want} <= set(got[i]["spans"].split(",")) | {""}


def test_written_out_addresses_are_added_and_clean_texts_stay(documents):
    rows = [(i, f"write to jo{i}.doe@mail.example.com or call +1 (456) 555-21{i:02d} from host 44.161.181.{i}") for i in range(60)]
    rows += [(100, "contact me: jane.roe [at] example [dot] com today"), (101, "call (456) 555-2186 now"),
             (102, "look at the dot on page 456 of section 12"), (103, "plain words only"), (104, None)]
    got = rows_of(personal_data.detect(documents(*rows)))
    assert got[100]["spans"] == "email:12:43" and got[100]["n_email"] == 0
    assert got[101]["spans"].startswith("phone:5:")
    assert [got[k]["spans"] for k in (102, 103, 104)] == ["", "", ""]
    changed = rows_of(personal_data.redact(documents(*rows)))
    assert changed[0]["text"] == "write to [EMAIL] or call [PHONE] from host [IP]" and changed[104]["text"] is None
    assert changed[100]["text"] == "contact me: [EMAIL] today" and changed[103]["text"] == "plain words only"
    assert set(changed[0]) == {"doc_id", "text", "key", "n"}
    assert personal_data.detect(documents((1, "x")).where("doc_id > 1")).count() == 0


def test_overlapping_spans_are_replaced_as_one(documents):
    texts = {
        "call +123456789012347 for the keynote talk": "call [PHONE] for the keynote talk",
        "host joe@10.20.30.40 then clean words": "host [EMAIL] then clean words",
        "10.20.30.40@example.com, 5.6.7.8 then é clean": "[EMAIL], [IP] then é clean",
        "mail 1.2.3.4.5.6.7.8@x.de, a@b.de or 1.2.3.4 here": "mail [EMAIL], [EMAIL] or [IP] here",
        "+1 (456) 555-2186@example.com stays": "[PHONE] stays",
        "0000000000000000.1.2.3 stays": "[IP] stays",
        "two: joe@10.20.30.40 and +123456789012347 and words": "two: [EMAIL] and [PHONE] and words",
    }
    got = rows_of(personal_data.redact(documents(*enumerate(texts))))
    assert [got[i]["text"] for i in range(len(texts))] == list(texts.values())


def test_labelers_found_reliable_are_those_that_agree():
    good, bad = (2, 2, 2, 2, 2), (1, 0, 0, 1, 2)
    model = personal_data.train([(0, good, 900), (0, bad, 800), (0, (2, 2, 1, 1, 2), 300), (0, (1, 0, 0, 0, 0), 200)])
    assert model.reliability["email", "format"] > 0.8 > model.reliability["email", "boundary"]


# --- language identification ---

LANGS = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["zwei", "größe", "über", "kraft"], "cc": ["çois", "été", "naïf", "où"]}


def language_rows(n, seed):
    chance = random.Random(seed)
    return [(i, " ".join(chance.choices(LANGS[lang], k=chance.choice((8, 40, 200)))), lang)
            for i, lang in enumerate(chance.choices(list(LANGS), k=n))]


def test_languages_of_held_out_texts(spark):
    rows = language_rows(200, 2) + [(900, None, "aa"), (901, "", "aa"), (902, "12 %% 3 ½²_", "bb"), (903, "lorem ipsum dolor", None), (None, "größe", "bb")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    aside = held_out(F.col("doc_id"), 5, 0)
    got = rows_of(language_id.predict(df, language_id.fit(df, seen=~aside), held_out=aside))
    assert len(got) == len(rows)
    unseen = [(k, lang) for k, t, lang in rows if k is not None and k < 900 and zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k]["held_out"] for k, _ in unseen)
    assert sum(got[k]["lang_pred"] == lang for k, lang in unseen) >= 0.95 * len(unseen)
    assert all((got[k]["lang_pred"], got[k]["score"]) == ("und", 0) for k in (900, 901, 902))
    assert got[903]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in got.values())


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "STEPS", 2)
    rows = [(i, f"text of the language number {i % 230}", f"l{i % 230}") for i in range(460)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    network = language_id.fit(df)
    assert set(network.languages) == {r[2] for r in rows}
    p = network.documents([t.encode() for _, t, _ in rows])
    assert p.shape == (460, 230) and p.sum(1) == pytest.approx(np.ones(460), rel=1e-3)


def test_nothing_learned_is_undetermined(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
    assert language_id.fit(df) is None
    assert language_id.predict(df, None).first()["lang_pred"] == "und"
    assert language_id.predict(df.where("doc_id > 1"), None).count() == 0


def test_gradients_equal_finite_differences():
    draw = np.random.default_rng(1)
    side = language_id.Direction(draw.normal(0, .4, (2 * language_id.UNITS, 256)).astype(np.float32),
                                 draw.normal(0, .4, (2 * language_id.UNITS, language_id.UNITS)).astype(np.float32))
    x = draw.integers(97, 102, (9, 4)).astype(np.uint8)
    weights = draw.normal(0, 1, (9, language_id.UNITS, 4)).astype(np.float32)

    def loss():
        out = np.empty((9, language_id.UNITS, 4), np.float32)
        side.run(x, out)
        return float((out.astype(np.float64) * weights).sum())

    kept = []
    side.run(x, np.empty((9, language_id.UNITS, 4), np.float32), kept)
    table, inner = side.back(x, kept, weights)
    for part, grad, at in ((side.table, table, (2, 98)), (side.table, table, (language_id.UNITS + 1, 99)), (side.inner, inner, (3, 1))):
        old = part[at]
        part[at] = old + 1e-2
        up = loss()
        part[at] = old - 1e-2
        down = loss()
        part[at] = old
        assert grad[at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=0.01)


# --- quality classifier ---

def test_quality_of_held_out_texts(spark):
    chance = random.Random(6)
    good = lambda: " ".join(chance.choices([f"w{i}" for i in range(300)], k=60))
    junk = lambda: " ".join(f"w{chance.randrange(300)}%%%" for _ in range(60))
    rows = [(i, good() if i % 3 else junk()) for i in range(240)] + [(900, None), (901, ""), (None, good()), (5, good())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] + [(3, 0), (None, 1), (7, None)], "doc_id bigint, quality int")
    aside = held_out(F.col("doc_id"), 4, 2)
    model = quality_classifier.fit(docs, labels, usable=~aside)
    got = quality_classifier.score(docs, model, held_out=aside).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    unseen = [r for r in got if r["held_out"] and r["doc_id"] < 240]
    assert unseen and sum((r["score"] >= 0.7) == (r["doc_id"] % 3 > 0) for r in unseen) >= 0.95 * len(unseen)


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    model = quality_classifier.fit(docs, labels)
    assert quality_classifier.score(docs, model).first()["score"] == 0.5
    assert quality_classifier.score(docs.where("doc_id > 1"), model).count() == 0
    one = quality_classifier.fit(docs, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int"))
    assert quality_classifier.score(docs, one).first()["score"] > 0.5


def test_context_sums_equal_brute_force():
    chance = random.Random(2)
    index = quality_classifier.index_vectors()
    rows = np.array([chance.randrange(40) for _ in range(500)])
    for size in (500, 7, 64):
        quality_classifier.AT_ONCE, old = size, quality_classifier.AT_ONCE
        total = np.zeros_like(index, dtype=np.int64)
        quality_classifier.add_contexts(total, index, rows)
        quality_classifier.AT_ONCE = old
        want = np.zeros_like(total)
        for i, w in enumerate(rows):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(rows):
                    want[w] += index[rows[j]]
        assert (total == want).all()


def test_every_word_has_its_own_sums_however_the_words_are_dealt(documents, monkeypatch):
    words = [f"w{i}" for i in range(20_000)]
    hashes = quality_classifier.word_hashes([w.encode() for w in words])
    low = np.unique(hashes & np.uint64(8191), return_counts=True)[1]
    assert low.max() > 1  # words that would share one of 8192 rows
    chance = random.Random(4)
    texts = [" ".join(words[i:i + 100]) for i in range(0, 20_000, 100)] + [" ".join(chance.choices(words[:50], k=80)), None, "", "one"]
    want = {}
    for t in texts:
        row = t.split() if t else []
        vectors = quality_classifier.index_vectors(quality_classifier.word_hashes([w.encode() for w in row]))
        for i, w in enumerate(row):
            near = [vectors[j] for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < len(row)]
            want[w] = want.get(w, 0) + sum(near, np.zeros(quality_classifier.SIZE, np.int64))
    got = {r[0]: r[1:] for r in quality_classifier.word_sums(documents(*enumerate(texts))).collect()}
    assert len(got) == len(want) == 20_001
    for w, sums in want.items():
        assert (np.array(got[int(quality_classifier.word_hashes([w.encode()]).view(np.int64)[0])]) == sums).all()
    assert (np.abs(quality_classifier.index_vectors(hashes)).sum(1) == quality_classifier.SIGNS).all()


def test_quality_texts_are_not_shuffled_and_sums_are_stored_small(documents, monkeypatch):
    monkeypatch.setattr(quality_classifier, "BUFFERED", 500)  # several blocks a task
    monkeypatch.setattr(quality_classifier, "SHARD_BYTES", 20_000)
    chance = random.Random(9)
    texts = [" ".join(f"w{chance.randrange(50) if chance.random() < 0.5 else chance.randrange(10 ** 9)}" for _ in range(100)) for _ in range(120)]
    docs = documents(*enumerate(texts), (500, None), (501, ""), (None, "w1"))
    model = quality_classifier.fit(docs, docs.sparkSession.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int"))
    distinct = len({w for t in texts for w in t.split()})
    stored = model.sums.agg(F.sum(F.octet_length("words") + F.octet_length("sums"))).first()[0]
    assert model.shards > 2 and stored < 24 * distinct  # 264 bytes a word as whole numbers
    scored = quality_classifier.score(docs, model)
    mode = docs.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", scored._jdf.queryExecution().explainString(mode))
    assert moved and not any("text#" in columns for columns in moved)
    got = {r[0]: r["score"] for r in scored.collect()}
    assert len(got) == len(texts) + 3 and math.isclose(got[500], got[501], rel_tol=1e-9)
    monkeypatch.setattr(quality_classifier, "BUFFERED", 10 ** 6)
    again = {r[0]: r["score"] for r in quality_classifier.score(docs.repartition(3), model).collect()}
    assert got.keys() == again.keys() and all(math.isclose(got[k], again[k], rel_tol=1e-9) for k in got)


def test_words_that_the_quality_model_lacks_have_no_vector(documents):
    docs = documents(*((i, " ".join(f"v{j}" for j in range(i, i + 30))) for i in range(40)))
    model = quality_classifier.fit(docs, docs.sparkSession.createDataFrame([(i, int(i > 20)) for i in range(40)], "doc_id bigint, quality int"))
    new = documents(*((i, f"x{i} y{i} z{i}") for i in range(40)), (40, "v30 x1 v31"))
    assert len(quality_classifier.score(new, model).collect()) == 41
    rows = new.select(F.col("doc_id").alias("key"), F.lit(False).alias("held_out"), "text")
    x = {r["key"]: r["x"][:2 * quality_classifier.SIZE] for r in quality_classifier._pooled_rows(rows, model.sums, model.shards).collect()}
    assert not any(any(x[i]) for i in range(40)) and any(x[40])


def test_added_spans_overlap_nothing_however_far_away(spark):
    chance = random.Random(7)
    kind = "array<struct<start:int,kind:int,end:int,base:boolean,votes:int>>"
    rows = []
    for i in range(60):
        found = set()
        for _ in range(chance.choice([0, 1, 5, 40, 300])):
            start = chance.randrange(900)
            found.add((start, chance.randrange(4), start + chance.choice([1, 5, 20, 400]), chance.random() < 0.3, chance.choice([0, 242])))
        rows.append((i, sorted(found)))
    classifier = personal_data.train([(k, (2,) * 5, 50) for k in range(4)] + [(k, (0,) * 5, 50) for k in range(4)])
    df = spark.createDataFrame(rows, f"id int, c {kind}")
    scored = df.select("id", personal_data.accepted(F.col("c"), classifier).alias("kept"),
                       F.transform("c", lambda s: classifier.score(s) >= personal_data.ACCEPT).alias("yes")).collect()
    all_of = dict(rows)
    for r in scored:
        chosen = [s for s, yes in zip(all_of[r["id"]], r["yes"]) if s[3] or yes]
        want = [s for s in chosen if s[3] or not any(
            o is not s and o[0] < s[2] and s[0] < o[2] and (o[3] or o[0] < s[0]) for o in chosen)]
        assert [tuple(s) for s in r["kept"]] == want
