"""Token alignment, substring deduplication and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quietgate.llm import blocks, spelling_variants, substring_dedup, token_alignment
from quietgate.llm.tokens import vocabulary

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# --- blocks -----------------------------------------------------------------------------------------------------------


@given(st.lists(st.integers(0, 2 ** 64 - 1), min_size=1, unique=True))
def test_sorted_keys_survive_packing(values):
    keys = np.array(sorted(values), np.uint64)
    assert (blocks.unpack_sorted(blocks.pack_sorted(keys)) == keys).all()


def test_blocks_follow_the_keys_and_hot_keys_are_dealt(documents):
    rows = [(i, "x" * 50) for i in range(300)] + [(7, "y" * 60) for _ in range(300)] + [(None, f"n{i}") for i in range(300)]
    made, total = blocks.in_blocks(documents(*rows), block_bytes=3000)
    assert total == sum(len(t) + blocks.ROW_BYTES for _, t in rows)
    of = defaultdict(set)
    for r in made.collect():
        of[r["key"]].add(r["block"])
    assert len(of[7]) > 3 and len(of[None]) > 2
    once = [(min(b), max(b)) for _, b in sorted((k, b) for k, b in of.items() if k is not None)]
    assert max(of[None]) <= once[0][0] and all(a[1] <= b[0] for a, b in zip(once, once[1:]))
    assert max(made.groupBy("block").agg(F.sum(F.length("text") + 32)).toPandas().iloc[:, 1]) < 9000


# --- substring deduplication ------------------------------------------------------------------------------------------


def plain_dedup(rows, window):
    """Per row in key order: (words, removed positions)."""
    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        words = WORDS.findall(text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i:i + window])
            if w in seen:
                gone.update(range(i, i + window))
            seen.add(w)
        out.append((key, words, gone))
    return out


@pytest.mark.parametrize("window", [1, 3, 20])
@pytest.mark.parametrize("block_bytes", [1 << 20, 900])
def test_repeated_passages_go(documents, monkeypatch, window, block_bytes):
    monkeypatch.setattr(substring_dedup, "in_blocks", lambda d, k, t: blocks.in_blocks(d, k, t, block_bytes))
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 2000)
    chance = random.Random(window)
    word = lambda n: " ".join(f"w{chance.randrange(40)}" for _ in range(n))
    passage = word(30)
    rows = [(i, f"{word(i % 35)}{' '}{passage if i % 3 else ''}\t{word(5)}") for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \n "), (103, "x " * 50), (104, rows[3][1]), (105, "Straße größe 中文 " * 9),
             (106, "a\x00b \x1c " + passage)]
    got = {r["doc_id"]: r for r in substring_dedup.deduplicated(documents(*rows), window=window).collect()}
    for key, words, gone in plain_dedup(rows, window):
        r = got.pop(key)
        assert (r["n_words"], r["n_removed"]) == (len(words), len(gone))
        assert r["kept"] == " ".join(w for i, w in enumerate(words) if i not in gone)
        assert [i for a, b in r["removed"] for i in range(a, b)] == sorted(gone)
        assert all(a[1] < b[0] for a, b in zip(r["removed"], r["removed"][1:]))  # maximal
    assert not got


def test_equal_keys_and_no_keys(documents, monkeypatch):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (None, text), (None, "other " + text), (2, text + " end")]
    for size in (1 << 20, 150):
        monkeypatch.setattr(substring_dedup, "in_blocks", lambda d, k, t: blocks.in_blocks(d, k, t, size))
        got = substring_dedup.deduplicated(documents(*rows)).collect()
        assert len(got) == 5 and sum(r["n_removed"] for r in got) == 120  # one of five keeps the passage
        kept = [r["doc_id"] for r in got if r["n_words"] - r["n_removed"] >= 30]
        assert kept == [None]


def test_very_long_text_and_empty_table(spark, documents):
    words = [f"w{i % 997}x{i // 997}" for i in range(200_000)]
    rows = [(2, " ".join(words)), (1, " ".join(words[50_000:50_100]))]
    got = {r["doc_id"]: r for r in substring_dedup.deduplicated(documents(*rows)).collect()}
    assert got[1]["n_removed"] == 0 and [tuple(x) for x in got[2]["removed"]] == [(50_000, 50_100)]
    none = documents((1, "a")).where("false")
    assert substring_dedup.deduplicated(none).count() == 0


def test_hash_rolls_over_every_window():
    hashes = np.random.default_rng(1).integers(0, 2 ** 63, 500, np.uint64)
    whole = substring_dedup.rolling(np.concatenate([hashes, hashes[100:200]]), 20)
    assert (whole[500:] == whole[100:181]).all() and len(set(whole.tolist())) == 581 - 81
    assert (substring_dedup.rolling(hashes[7:60], 20) == whole[7:41]).all()
    assert len(substring_dedup.rolling(hashes[:19], 20)) == 0


# --- spelling variants ------------------------------------------------------------------------------------------------


def one_edit(u, v):
    if u == v:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    if len(u) > len(v):
        u, v = v, u
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abé", min_size=0, max_size=7), min_size=1, max_size=60))
def test_composition_accepts_the_near_pairs_once(words):
    listed = sorted(words)
    got = [tuple(sorted(p)) for p in spelling_variants.near_pairs(listed)]
    assert len(got) == len(set(got))
    assert set(got) == {(u, v) for u in listed for v in listed if u < v and one_edit(u, v)}


def test_acceptor_is_minimal_and_accepts_its_words():
    words = sorted(a + b for a in ("un", "re", "") for b in ("loading", "locking", "loaded", "locked"))
    made = spelling_variants.Acceptor(words)

    def language(state):
        return frozenset({""} if made.final[state] else set()) | {c + w for c, to in made.arcs[state].items() for w in language(to)}
    languages = [language(s) for s in made.states()]
    assert language(0) == set(words) and len(set(languages)) == len(languages)


def plain_variants(rows, letters=6, least=5):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= letters and c >= least}
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w
    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize("split_letters", [500_000, 60])
def test_variants_of_a_corpus(documents, monkeypatch, split_letters):
    near = spelling_variants.near
    monkeypatch.setattr(spelling_variants, "near", lambda w, least: near(w, least, split_letters))
    chance = random.Random(5)
    base = ["commonly", "fréquent", "aaaaaaaa", "letters", "abababab", "prefixone", "prefixtwo"]
    words = Counter()
    for w in base:
        words[w] = 150
        for _ in range(40):
            i, c = chance.randrange(len(w) + 1), chance.choice("abyé")
            words[chance.choice((w[:i] + c + w[i:], w[:i] + w[i + 1:], w[:i] + c + w[i + 1:]))] += chance.choice((1, 6, 26))
    words.update({"straßen": 9, "Commonlé": 7, "comonlé": 6, "zephyrus": 150, "zephyruss": 28, "zephyrussy": 5})
    stream = list(words.elements())
    chance.shuffle(stream)
    rows = [(i, " ".join(stream[i * 60:i * 60 + 60]).replace(" a", ", A")) for i in range(len(stream) // 60 + 1)]
    rows += [(None, "commonly letters"), (1000, None), (1001, ""), (1002, "12 !"), rows[0], rows[0]]
    rows += [(2000 + i, "x" * 30_000 + " " + "x" * 30_001) for i in range(6)]
    want = plain_variants(rows)
    got = spelling_variants.variants(documents(*rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(w[1] and w[2] != w[1] for w in want)  # a chain of forms


def test_no_frequent_words(documents):
    assert spelling_variants.variants(documents((1, "a few rare words"), (2, None))).count() == 0
    assert spelling_variants.variants(documents((1, "a")).where("false")).count() == 0


# --- token alignment --------------------------------------------------------------------------------------------------

PATHS = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
TEXT = st.text(st.sampled_from(list("ab Z.,'é9\n\t\r  ▁<>0x中😀́")) | st.characters(codec="utf-8"), max_size=40)


def whole_ids(text):
    tools = token_alignment.Tokenizers.of(PATHS)
    return tools.a.encode(" " + text, add_special_tokens=False).ids, tools.b.encode(text)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_pieces_encode_like_whole_texts(text):
    tools = token_alignment.Tokenizers.of(PATHS)
    pieces = token_alignment.pieces_of(text)
    assert "".join(map(token_alignment.spelled, pieces)) == (" " + text if text else "")
    a, b = tools.ids(pieces) if pieces else ([], [])
    assert tools.ranked is not None
    assert (sum(a, []), sum(b, [])) == (whole_ids(text) if text else ([], []))


def plain_alignment(rows):
    tools = token_alignment.Tokenizers.of(PATHS)
    linked, total = {}, Counter()
    for at, (_, text) in enumerate(rows):
        a, b = whole_ids(text) if text else ([], [])
        whole = (" " + (text or "")).encode()
        spans = []
        for ids, of in ((a, tools.a_bytes), (b, tools.b_bytes)):
            end, made = 0, []
            for i in ids:
                made.append((i, end, end + len(of[i])))
                end += len(of[i])
            spans.append(made)
        sound = text and all(b"".join(of[i] for i in ids) == whole for ids, of in ((a, tools.a_bytes), (b, tools.b_bytes)))
        x, y = spans if sound else ([], [])
        links = [(p[0], q[0]) for p in x for q in y if p[1] < q[2] and q[1] < p[2]]
        ends = sorted({p[2] for p in x} & {q[2] for q in y})
        groups = [";".join(f"{','.join(str(p[0]) for p in x if s < p[2] <= e)}|{','.join(str(q[0]) for q in y if s < q[2] <= e)}"
                           for s, e in zip([0, *ends], ends))]
        linked[at] = len(x), len(y), len(ends), links, groups[0]
        total.update(links)
    best = defaultdict(int)
    for (_, b), n in total.items():
        best[b] = max(best[b], n)
    return [(k, na, nb, ng, len(ls), sum(total[p] == best[p[1]] for p in ls), sum(total[p] for p in ls), groups)
            for (k, _), (na, nb, ng, ls, groups) in zip(rows, linked.values())]


@pytest.mark.parametrize("block_bytes", [1 << 20, 700])
def test_alignment_of_a_corpus(documents, monkeypatch, block_bytes):
    monkeypatch.setattr(token_alignment, "in_blocks", lambda d, k, t: blocks.in_blocks(d, k, t, block_bytes))
    monkeypatch.setattr(token_alignment, "SHARD_BYTES", 900)
    chance = random.Random(3)
    parts = ["unbelievable", "Straße", "the", "naïve,", "I'm", "12345", "x=y;", "中文字", "😀😀", "tokenization", "a▁b"]
    rows = [(i, " ".join(chance.choices(parts[:-1], k=20))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " two  blanks "), (103, "line\nbreak\r\n\tx"), (104, "has ▁ inside it"), (105, "<s> <|endoftext|> </s>"),
             (106, "\n\nlead"), (None, "no key here"), rows[0], (107, "é ﬁ \x00 \x1c."), (108, "<0x0A>\n"), (109, "word " * 400)]
    found = token_alignment.aligned(documents(*rows), *PATHS)
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    want = plain_alignment(rows)
    assert got == sorted(want, key=repr)
    assert next(w for w in want if w[0] == 104)[1] == 0 and next(w for w in want if w[0] == 105)[1] > 0
    hashed = {r["doc_id"]: r["groups_sha256"] for r in token_alignment.digest(found).collect()}
    assert hashed[100] == hashed[104] == "" and hashed[1] == hashlib.sha256(want[1][7].encode()).hexdigest()


def test_alignment_in_whatever_order_a_block_is_read():
    """A remote shuffle gives a block's rows in one order when it asks and in another when it takes the answers."""
    chance = random.Random(4)
    rows = [(i, " ".join(chance.choices(["unbelievable", "Straße", "the", "naïve,", "I'm", "12345", "x=y;", "😀😀"], k=3))) for i in range(30)]
    table = pa.table({"key": [k for k, _ in rows], "text": [t for _, t in rows], "block": pa.array([5] * len(rows), pa.int32())})
    only = lambda messages, column, n: messages.filter(pc.equal(messages.column(column), n))
    asked = token_alignment._asking(PATHS, 3)(table)
    shards = [only(asked, "shard", s) for s in range(3)]
    pairs = pa.concat_tables([token_alignment._pair_counts(PATHS, 2)(part) for part in shards])
    totals = pa.concat_tables([token_alignment._totals(only(pairs, "shard", s)) for s in range(2)])
    answers = pa.concat_tables([token_alignment._answering(PATHS, 2)(part, only(totals, "origin", s)) for s, part in enumerate(shards)])
    want = plain_alignment(rows)
    for read in (table, table.take(list(reversed(range(len(rows)))))):
        found = token_alignment._finishing(PATHS, 3)(read, answers).to_pylist()
        assert sorted(tuple(r.values()) for r in found) == want


def test_alignment_of_nothing_and_of_a_very_long_text(documents):
    assert token_alignment.aligned(documents((1, "a")).where("false"), *PATHS).count() == 0
    assert [tuple(r)[1:] for r in token_alignment.aligned(documents((1, None), (2, "")), *PATHS).collect()] == [(0,) * 6 + ("",)] * 2
    long = " ".join(f"word{i % 5000}" for i in range(100_000)) + "  " + "y" * 20_000
    r = token_alignment.aligned(documents((1, long)), *PATHS).first()
    a, b = whole_ids(long)
    assert (r["n_a"], r["n_b"]) == (len(a), len(b)) and r["n_groups"] == r["groups"].count("|")
