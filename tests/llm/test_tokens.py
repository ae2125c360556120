"""Token ids, grammar-compressed shards, packing and length histogram."""

import random
import uuid
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from quietgate.llm import grammar_store as store, length_histogram, packing, tokens
from quietgate.llm.common import shared_folder
from quietgate.llm.tokens import Coder, vocabulary

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
ODD = ["", "a\n b", "  x y", "a\tb c", "é́ ́x", "don't  's ", " a", "a b c", "a　 b", "x's 't y <|endoftext|> z", "\n\n",
       "ÀÉ Σας ΣΑΣ İx", "½² Ⅷ 12 3a_b", "x\x85y\xa0z q", "a\x1cb c\x1d", "_ - 'LL I'LL don'T", "word. Word, WORD.\nWord", "ab " * 3000]


def whole(name, text):
    tokenizer = Tokenizer.from_file(vocabulary(name))
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_pieces_give_the_ids_of_whole_texts(name):
    made = Coder.of(vocabulary(name)).encode([*ODD, None])
    assert [np.frombuffer(m, "<u4").tolist() for m in made[:-1]] == [whole(name, t) for t in ODD]
    assert made[-1] == b""


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(text=st.text(st.sampled_from("abzAZéÉßñΣσ'.,!019 \n\t　́-_"), max_size=40))
def test_any_text_is_encoded_like_the_library_does(name, text):
    assert np.frombuffer(Coder.of(vocabulary(name)).encode([text])[0], "<u4").tolist() == whole(name, text)


@settings(max_examples=60, deadline=None)
@given(ids=st.lists(st.integers(0, 6), max_size=400), cut=st.tuples(st.integers(0, 400), st.integers(0, 400)))
def test_grammar_expands_to_what_was_compressed(ids, cut):
    grammar = store.compress(np.array(ids, np.uint32), 10)
    assert store.expand(grammar).tolist() == ids
    assert store.expand(grammar, *cut).tolist() == ids[cut[0]:cut[0] + cut[1]]


def test_grammar_is_shorter_than_repetitive_ids():
    ids = np.tile(np.arange(50, dtype=np.uint32), 400)
    grammar = store.compress(ids, 100)
    assert len(grammar.sequence) + grammar.rules.size < len(ids) / 8


def rows_for_tokens():
    chance = random.Random(1)
    words = ["the", "of", "lange", "Wörter,", "naïve", "x1", "end."]
    rows = [(i, " ".join(chance.choices(words, k=chance.choice((0, 1, 5, 90, 700, 3000))))) for i in range(60)]
    return [*rows, (7, rows[7][1]), (100, None), (101, ""), (None, "no key"), (102, "\n x")]


def test_shards_read_back_in_key_order(spark, documents):
    rows = rows_for_tokens()
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    store.write(documents(*rows).repartition(4), folder, vocabulary(FILES[0]), shard_tokens=5000)
    got = store.read(spark, folder).orderBy("start").collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got) == [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert len(got) == len(rows)
    texts = dict(rows)
    place = 0
    for r in got:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert ids == whole(FILES[0], texts[r["doc_id"]] or "") + [1]
        assert (r["start"], r["n_tokens"]) == (place, len(ids))
        place += len(ids)
    sums = store.read(spark, folder, checksums=True).orderBy("start").collect()
    assert [(r["start"], r["ids_crc32"]) for r in sums] == [(r["start"], zlib.crc32(bytes(r["ids"]))) for r in got]
    first = store.shards(spark, folder).orderBy("part", "shard").first()
    some = store.token_range(spark, folder, first["part"], first["shard"], 3, 40)
    assert some.tolist() == store.expand(store.grammar_of(first.asDict()))[3:43].tolist()


def test_empty_table_gives_no_rows(spark, documents):
    none = documents((1, "x")).where("doc_id > 5")
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    store.write(none, folder, vocabulary(FILES[0]))
    assert store.read(spark, folder).count() == 0
    assert packing.pack(none, vocabulary(FILES[1])).count() == 0
    assert length_histogram.histogram(none, vocabulary(FILES[1])).count() == 0


def test_every_id_is_packed_once_without_gaps_or_padding(documents):
    rows = rows_for_tokens()
    pieces = packing.pack(documents(*rows).coalesce(2), vocabulary(FILES[1])).collect()
    texts = [(k, whole(FILES[1], t or "") + [0]) for k, t in rows]
    found = {}
    for p in pieces:
        ids = np.frombuffer(bytes(p["ids"]), "<u4").tolist()
        assert len(ids) == p["length"]
        found.setdefault((p["doc_id"], p["start"]), []).append((ids, p["doc_tokens"]))
    for key, ids in texts:
        at = 0
        while at < len(ids):
            piece, total = found[key, at].pop()
            assert piece == ids[at:at + len(piece)] and total == len(ids)
            at += len(piece)
    assert not any(found.values())
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"], p["tier"]))
    for parts in sequences.values():
        place = 0
        for offset, length, _ in sorted(parts):
            assert offset == place
            place += length
        assert {place} == {t for *_, t in parts} and place <= 1024 and place & (place - 1) == 0


def test_step_groups_hold_the_same_number_of_tokens(documents):
    rows = [(i, "word " * (i % 90 + 3) + "end") for i in range(900)]
    pieces = packing.pack(documents(*rows).coalesce(1), vocabulary(FILES[1])).collect()
    groups = {}
    for p in pieces:
        groups.setdefault((p["tier"], p["step_group"]), 0)
        groups[p["tier"], p["step_group"]] += p["length"]
    assert sum(n != packing.STEP_TOKENS for n in groups.values()) <= len({t for t, _ in groups})
    assert all(p["tier"] <= 128 for p in pieces)  # short documents need no long window


def test_histogram_answers_totals_quantiles_and_truncated_totals(documents):
    rows = rows_for_tokens()
    lengths = sorted(len(whole(FILES[1], t or "")) for _, t in rows)
    hist = length_histogram.histogram(documents(*rows), vocabulary(FILES[1]))
    got = {r["length"]: r for r in hist.collect()}
    assert sorted(got) == sorted(set(lengths))
    for n, r in got.items():
        assert r["n_docs"] == lengths.count(n) and r["n_tokens"] == n * lengths.count(n)
        assert r["docs_at_least"] == sum(x >= n for x in lengths) and r["tokens_at_least"] == sum(x for x in lengths if x >= n)
        assert r["docs_at_most"] == sum(x <= n for x in lengths)
        assert r["truncated_tokens"] == sum(min(x, n) for x in lengths) and r["lost_tokens"] == sum(lengths) - r["truncated_tokens"]
        assert (r["total_docs"], r["total_tokens"]) == (len(lengths), sum(lengths))
    for limit in (0, 10, 100, 5000):
        row = length_histogram.truncated_total(hist, limit).first()
        assert tuple(row) == (sum(min(x, limit) for x in lengths), sum(x > limit for x in lengths))
    for q in (0.1, 0.5, 0.9, 1.0):
        assert length_histogram.quantile(hist, q).first()[0] == next(x for i, x in enumerate(lengths, 1) if i >= q * len(lengths))


def test_copies_shrink_as_far_as_they_repeat():
    ids = np.tile(np.random.default_rng(2).integers(0, 40_000, 500).astype("<u4"), 2000)
    made = store.compress(ids, 1 << 16)
    assert (store.expand(made) == ids).all()
    assert ids.nbytes > 100 * (made.rules.nbytes + made.expansions.nbytes + made.sequence.nbytes)


@pytest.mark.parametrize("name", FILES)
def test_a_piece_in_use_is_not_encoded_anew_when_the_tables_are_full(name, monkeypatch):
    monkeypatch.setattr(tokens, "_KNOWN_PIECES", 20)
    coder = Coder(vocabulary(name))
    real, asked = coder.tokenizer, []

    def tokenize(shown):
        asked.append(shown.lower().lstrip("Ġ"))
        return real.model.tokenize(shown)

    coder.tokenizer = SimpleNamespace(model=SimpleNamespace(tokenize=tokenize), encode_batch_fast=real.encode_batch_fast)
    for i in range(0, 300, 30):
        rare = "".join(f" x{'abcdefghij'[j // 100]}{'abcdefghij'[j // 10 % 10]}{'abcdefghij'[j % 10]}" for j in range(i, i + 30))
        text = f"First{rare} common, common. Größe\nLine\ncommon 12,5\n3 end,"
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == real.encode(text, add_special_tokens=False).ids
    assert asked.count("common") <= 2  # after a space, and after a line feed
