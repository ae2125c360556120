"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a sentencepiece model (B) cover the same bytes.

The cumulative byte ends of both token lists are put into dictionaries from end to index; the keys both have, sorted, slice
the two id lists into groups, and inside the slices the tokens whose byte ranges overlap are linked.

Both tokenizers always cut before a single space or line feed between two other characters, so a text is a list of such
pieces, and its groups are those of its pieces.  A block of documents asks for each of its distinct pieces once; the shards
of pieces encode and align each piece of the corpus.  How often a piece occurs gives the counts of the id pairs it links:
the shards of pieces send them to shards of B ids, which answer with totals and whether they are the B id's highest.
A block then only adds up and joins what its pieces came back with.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from quietgate.llm.blocks import MESSAGE_DDL, asked, dealt, in_blocks, in_order, messages, parts_of
from quietgate.llm.common import give_back

SHARD_BYTES = 16 << 20  # text whose distinct pieces one shard takes
B_SHARDS = 16           # of B ids at least, and one more for every fourth shard of pieces
_BREAK = re.compile(r"(?<=\S)(?=[ \n]\S)")
_ENCODE_AT_ONCE = 4096
_OUT = ("key bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string")
_loaded: dict[tuple[str, str], Tokenizers] = {}


def pieces_of(text: str | None) -> list[str]:
    """Pieces of space + text, each without its leading space unless white space follows it."""
    if not text:
        return []
    words, gaps = text.split(), text.count(" ") + text.count("\n")
    if len(words) == gaps + 1 and len("".join(words)) == len(text) - gaps:  # nothing but single spaces and line feeds
        return text.replace("\n", " \n").split(" ")
    first, *rest = _BREAK.split(text)
    return [" " + first if first[0] in " \n" else first, *(p[1:] if p[0] == " " else p for p in rest)]


def spelled(piece: str) -> str:
    """What a piece stands for in space + text."""
    return piece if piece[0] in " \n" else " " + piece


class Tokenizers:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = self._byte_level()
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.ranked = self._ranked()
        self.a_size, self.b_size = (np.array(list(map(len, of)), np.int64) for of in (self.a_bytes, self.b_bytes))

    @staticmethod
    def of(paths: tuple[str, str]) -> Tokenizers:
        """One pair per worker process."""
        if paths not in _loaded:
            _loaded[paths] = Tokenizers(*paths)
        return _loaded[paths]

    def _byte_level(self) -> list[bytes]:
        """Token bytes of the byte-level alphabet: printable Latin-1 stands for itself, other bytes for U+0100 on."""
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = sorted(set(range(256)).difference(printable))
        byte = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}
        size = self.a.get_vocab_size(with_added_tokens=False)
        shown = [self.a.id_to_token(i) or "" for i in range(size)]
        return [bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode() for token in shown]

    def _ranked(self) -> tiktoken.Encoding | None:
        """A in tiktoken's form, which encodes short pieces faster: for a plain byte-level BPE whose merges are in the order of their ids."""
        spec = json.loads(self.a.to_str())
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["type"] != "BPE" or model["dropout"]:
            return None
        made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if made != list(range(256, 256 + len(made))) or 256 + len(made) != len(set(self.a_bytes[:256 + len(made)])):
            return None
        ranks = {token: i for i, token in enumerate(self.a_bytes[:256 + len(made)])}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def lossy(self, chars: set[str]) -> set[str]:
        """Characters that do not come back alone; texts without any come back whole, which is checked where they are aligned.

        A space is no piece of its own.
        """
        listed = sorted(chars - {" "})
        a, b = self.ids(listed)
        back = lambda ids, of: b"".join(map(of.__getitem__, ids))
        return {c for c, x, y in zip(listed, a, b)
                if not back(x, self.a_bytes) == back(y, self.b_bytes) == spelled(c).encode()}

    def ids(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both tokenizers for every piece."""
        whole = [spelled(p) for p in pieces]
        if self.ranked is None:
            a = [made.ids for made in self.a.encode_batch_fast(whole, add_special_tokens=False)]
        else:
            a = list(map(self.ranked.encode_ordinary, whole))
        # B puts a space before a text: it stands for the piece's own, or is a token of its own before a line feed.
        b = self.b.encode([p[1:] if p[0] == " " else p for p in whole], num_threads=1)
        return a, [y if p[0] == " " else y[1:] for p, y in zip(whole, b)]


def common_ends(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int]]:
    """Where both token lists end at the same byte: the indices behind those tokens, in order."""
    a_at, b_at = {e: i + 1 for i, e in enumerate(a_ends)}, {e: i + 1 for i, e in enumerate(b_ends)}
    common = sorted(a_at.keys() & b_at.keys())
    return [a_at[e] for e in common], [b_at[e] for e in common]


def linked(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the overlapping tokens of two lists over the same bytes.

    Between one end and the next, of either list, exactly one token of each list covers the bytes; no two such stretches
    have the same two tokens.
    """
    ends = np.union1d(a_ends, b_ends)
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)


class Alignment:
    """Pieces of text aligned together: one list of tokens each, ends counted through all pieces."""

    def __init__(self, pieces: list[str], tools: Tokenizers, show: bool):
        a, b = tools.ids(pieces)
        whole = [spelled(p).encode() for p in pieces]
        size = np.fromiter(map(len, whole), np.int64, len(whole))
        self.sound = self._gives(a, tools.a_bytes, tools.a_size, whole, size) & self._gives(b, tools.b_bytes, tools.b_size, whole, size)
        if not self.sound.all():
            a, b = ([ids if ok else [] for ids, ok in zip(of, self.sound)] for of in (a, b))
        n_a, n_b = (np.fromiter(map(len, of), np.int64, len(of)) for of in (a, b))
        a_ids, b_ids = (np.fromiter(chain.from_iterable(of), np.int64) for of in (a, b))
        a_ends, b_ends = np.cumsum(tools.a_size[a_ids]), np.cumsum(tools.b_size[b_ids])
        ends = np.cumsum(n_a)
        behind_a, behind_b = common_ends(a_ends.tolist(), b_ends.tolist())
        links_a, links_b = linked(a_ends, b_ends)
        self.codes = (b_ids[links_b].astype(np.uint64) << np.uint64(32)) | a_ids[links_a].astype(np.uint64)
        groups = np.searchsorted(behind_a, ends, "right")
        links = np.searchsorted(links_a, ends, "left")
        self.counts = np.array([n_a, n_b, np.diff(groups, prepend=0), np.diff(links, prepend=0)])
        self.shown: list[str] = []
        if show:
            shown = self._shown(a_ids, b_ids, np.array(behind_a, np.int64), np.array(behind_b, np.int64))
            self.shown = [";".join(shown[x:y]) for x, y in zip([0, *groups.tolist()], groups.tolist())]

    @staticmethod
    def _gives(tokens: list[list[int]], of: list[bytes], sizes: np.ndarray, whole: list[bytes], size: np.ndarray) -> np.ndarray:
        """Which pieces their tokens give back byte for byte: as a rule all, which one comparison tells."""
        n, flat = np.fromiter(map(len, tokens), np.int64, len(tokens)), list(chain.from_iterable(tokens))
        ends = np.append(0, np.cumsum(sizes[flat]))[np.cumsum(n)] if flat else np.zeros(len(n), np.int64)
        if (np.diff(ends, prepend=0) == size).all() and b"".join(map(of.__getitem__, flat)) == b"".join(whole):
            return np.ones(len(whole), bool)
        return np.array([b"".join(map(of.__getitem__, ids)) == text for ids, text in zip(tokens, whole)], bool)

    @staticmethod
    def _shown(a: np.ndarray, b: np.ndarray, behind_a: np.ndarray, behind_b: np.ndarray) -> list[str]:
        """Every group as ``a1,a2|b1``."""
        before_a, before_b = np.append(0, behind_a[:-1]), np.append(0, behind_b[:-1])
        single = (behind_a - before_a == 1) & (behind_b - before_b == 1)
        out = [f"{x}|{y}" for x, y in zip(a[behind_a - 1].tolist(), b[behind_b - 1].tolist())] if len(behind_a) else []
        for k in np.flatnonzero(~single).tolist():
            x, y = a[before_a[k]:behind_a[k]].tolist(), b[before_b[k]:behind_b[k]].tolist()
            out[k] = f"{','.join(map(str, x))}|{','.join(map(str, y))}"
        return out


class _Numbered(dict):
    """Numbers things in the order of their first appearance."""

    def __missing__(self, thing):
        number = self[thing] = len(self)
        return number


def _summed(groups: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Whole-number sums; two halves keep them exact in the doubles of bincount."""
    high, low = values >> 26, values & ((1 << 26) - 1)
    return (np.bincount(groups, high, size).astype(np.int64) << 26) + np.bincount(groups, low, size).astype(np.int64)


def _packed(**columns) -> bytes:
    """Columns of one length, compressed."""
    made = pa.table(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, made.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(made)
    return sink.getvalue().to_pybytes()


def _unpacked(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


def _whole_numbers(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy()


class _Block:
    """A block's documents as numbers of distinct pieces, which are ordered by their shards and texts."""

    def __init__(self, table: pa.Table, paths: tuple[str, str], shards: int):
        self.keys, texts = table.column("key").to_pylist(), table.column("text").to_pylist()
        lossy = Tokenizers.of(paths).lossy(set().union(*filter(None, texts)))
        numbered = _Numbered()
        number = numbered.__getitem__
        self.documents: list[np.ndarray] = []
        for text in texts:
            pieces = pieces_of(text)
            if lossy and pieces and not lossy.isdisjoint(text) and not Alignment(pieces, Tokenizers.of(paths), False).sound.all():
                pieces = []  # a text that does not come back has no tokens at all
            self.documents.append(np.fromiter(map(number, pieces), np.int64, len(pieces)))
        pieces = sorted(numbered)  # a block read again may have its rows in another order: the pieces keep theirs
        hashed = np.fromiter((xxhash.xxh3_64_intdigest(p.encode()) for p in pieces), np.uint64, len(pieces))
        shard = ((hashed >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        self.pieces, self.shards = [pieces[i] for i in order.tolist()], shard[order]
        place = np.empty(len(pieces), np.int64)
        place[np.fromiter(map(number, self.pieces), np.int64, len(pieces))] = np.arange(len(pieces))
        self.documents = [place[d] for d in self.documents]


def _asking(paths: tuple[str, str], shards: int):
    """Every distinct piece of a block and how often it occurs there."""
    def run(table: pa.Table) -> pa.Table:
        number, block = int(table.column("block")[0].as_py()), _Block(table, paths, shards)
        times = np.bincount(np.concatenate([np.empty(0, np.int64), *block.documents]), minlength=len(block.pieces))
        return messages([(number, s, _packed(piece=block.pieces[x:y], n=times[x:y])) for s, x, y in parts_of(block.shards)])
    return run


class _Pieces:
    """Distinct pieces of a shard, aligned, with the distinct id pairs they link and their counts."""

    def __init__(self, table: pa.Table, paths: tuple[str, str], b_shards: int, show: bool):
        self.rows = in_order(table, "origin")
        numbered = _Numbered()
        self.asked, counts = [], []
        for _, _, body in self.rows:
            sent = _unpacked(body)
            self.asked.append(np.fromiter(map(numbered.__getitem__, sent.column("piece").to_pylist()), np.int64, sent.num_rows))
            counts.append(_whole_numbers(sent, "n"))
        pieces, tools = list(numbered), Tokenizers.of(paths)
        parts = [Alignment(pieces[at:at + _ENCODE_AT_ONCE], tools, show) for at in range(0, len(pieces), _ENCODE_AT_ONCE)]
        if not all(p.sound.all() for p in parts):
            raise ValueError("a tokenizer alters texts none of whose characters it alters alone")
        times = _summed(np.concatenate(self.asked), np.concatenate(counts), len(pieces))
        self.shown = [s for p in parts for s in p.shown]
        self.counts = np.concatenate([p.counts for p in parts], axis=1)  # A ids, B ids, groups, links
        self.piece_of_link = np.repeat(np.arange(len(pieces)), self.counts[3])
        # Pairs are codes of B id and A id, so those of one B id lie side by side.
        self.codes, self.which = np.unique(np.concatenate([p.codes for p in parts]), return_inverse=True)
        self.uses = _summed(self.which, times[self.piece_of_link], len(self.codes))
        shard = (self.codes >> np.uint64(32)).astype(np.int64) % b_shards
        self.order = np.argsort(shard, kind="stable")
        self.shards = shard[self.order]


def _pair_counts(paths: tuple[str, str], b_shards: int):
    def run(table: pa.Table) -> pa.Table:
        made = _Pieces(table, paths, b_shards, False)
        codes, uses = made.codes[made.order], made.uses[made.order]
        return messages([(made.rows[0][1], s, _packed(code=codes[x:y], n=uses[x:y])) for s, x, y in parts_of(made.shards)])
    return run


def _totals(table: pa.Table) -> pa.Table:
    """Totals of the pairs of some B ids to every shard of pieces as asked, negative where not the highest of their B id."""
    rows = in_order(table, "origin")
    sent = [_unpacked(body) for _, _, body in rows]
    codes = [_whole_numbers(t, "code") for t in sent]
    distinct, which = np.unique(np.concatenate(codes), return_inverse=True)
    totals = _summed(which, np.concatenate([_whole_numbers(t, "n") for t in sent]), len(distinct))
    _, of_b = np.unique(distinct >> np.uint64(32), return_inverse=True)
    best = np.zeros(int(of_b.max()) + 1, np.int64)
    np.maximum.at(best, of_b, totals)
    marked = np.where(totals == best[of_b], totals, -totals)
    return messages([(origin, shard, _packed(n=marked[np.searchsorted(distinct, c)])) for (origin, shard, _), c in zip(rows, codes)])


_COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _answering(paths: tuple[str, str], b_shards: int):
    """What became of its pieces, to every block in the order asked."""
    def run(table: pa.Table, totals: pa.Table) -> pa.Table:
        made = _Pieces(table, paths, b_shards, True)
        marked = np.zeros(len(made.codes), np.int64)
        marked[made.order] = np.concatenate([np.empty(0, np.int64), *(
            _whole_numbers(_unpacked(body), "n") for _, _, body in in_order(totals, "shard"))])
        link, pieces = marked[made.which], made.counts.shape[1]
        sums = [*made.counts, _summed(made.piece_of_link, (link > 0).astype(np.int64), pieces),
                _summed(made.piece_of_link, np.abs(link), pieces)]
        shown = np.array(made.shown, object)
        return messages([(block, shard, _packed(groups=pa.array(shown[at], pa.string()), **{n: x[at] for n, x in zip(_COLUMNS, sums)}))
                         for (block, shard, _), at in zip(made.rows, made.asked)])
    return run


def _finishing(paths: tuple[str, str], shards: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(table, paths, shards)
        parts = [_unpacked(body) for _, _, body in in_order(answers, "shard")]
        shown = [g for p in parts for g in p.column("groups").to_pylist()]
        flat = np.concatenate([np.empty(0, np.int64), *block.documents])
        ends = np.cumsum([0, *map(len, block.documents)])
        sums = {}
        for name in _COLUMNS:
            per_piece = np.concatenate([np.empty(0, np.int64), *(_whole_numbers(p, name) for p in parts)])
            running = np.append(0, np.cumsum(per_piece[flat]))
            sums[name] = running[ends[1:]] - running[ends[:-1]]
        groups = [";".join(map(shown.__getitem__, d.tolist())) for d in block.documents]
        made = pa.table({"key": pa.array(block.keys, pa.int64()), **sums, "groups": pa.array(groups, pa.string())})
        del block, parts, shown, groups
        give_back()
        return made
    return run


def aligned(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row.

    A encodes space + text, B the text, which it starts with a space of its own; special tokens' strings are ordinary
    text.  ``groups`` lists the ids between common byte ends as ``a1,a2|b1;a3|b2``.  A link is a pair of overlapping
    tokens; its count is how many links of the whole corpus hold its two ids.  ``n_best`` counts the links whose count
    is the highest of their B id, ties included, ``count_sum`` adds up all counts.  Null and empty texts, and texts that
    either tokenizer does not give back byte for byte, have no tokens: zeros and an empty ``groups``.  Texts of any
    length are taken whole.  Repeated rows count and are returned each; a null key stays null; an empty table gives no
    rows.  Other columns are not read.
    """
    rows, total = in_blocks(docs, key, text)
    paths, shards = (a_path, b_path), max(1, -(-total // SHARD_BYTES))
    blocks = dealt(rows, "block")
    pieces = dealt(blocks.groupBy("block").applyInArrow(_asking(paths, shards), MESSAGE_DDL), "shard")
    b_shards = B_SHARDS + shards // 4
    answers = asked(pieces, "shard", _pair_counts(paths, b_shards), _totals, _answering(paths, b_shards), MESSAGE_DDL)
    made = blocks.groupBy("block").cogroup(answers.groupBy("origin")).applyInArrow(_finishing(paths, shards), _OUT)
    return made.withColumnRenamed("key", key)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and the hash of the groups, without tokens an empty string."""
    hashed = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise(F.lit(""))
    return found.select(key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", hashed.alias("groups_sha256"))
