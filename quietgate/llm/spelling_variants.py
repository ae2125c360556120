"""Spelling variants: frequent words one edit apart, by finite-state composition.

The vocabulary is counted with built-in functions.  Words that may be near are brought together in blocks: if one edit turns
a word of length l into another of length l or l + 1, the first or the second half of the shorter one is untouched, so
both start or both end with it.  A block is thus the part of the vocabulary that can be reached from one initial state
(a head that is read, or a tail that is to come).  In each block the minimised acceptor of its words is composed with the
one-edit transducer and with itself again, and the accepted pairs are enumerated.  A block of too many letters is split
by the same rule, by the halves of what its words do not share yet, so no common head or tail fills a task.

Each word's form is its most frequent near word; roots follow the forms by pointer jumping.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quietgate.llm.common import Batches, Made, cut, record

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS = 6
LEAST_COUNT = 5
FORM_RATIO = 5          # a form is at least so many times as frequent
DELETE_EVERY = 199      # runs whose checksum it divides lose one letter
SPLIT_LETTERS = 500_000  # in a block; beyond it the block is split
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PAIRS = pa.schema([("u", pa.string()), ("v", pa.string()), ("n_u", pa.int64()), ("n_v", pa.int64())])
_PAIRS_DDL = "u string, v string, n_u bigint, n_v bigint"


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS,
               least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z lowered, with a letter left out of some, and how often they occur."""
    runs = docs.select(F.col(key).alias("k"), F.explode(F.regexp_extract_all(
        F.translate(text, _UPPER, _UPPER.lower()), F.lit(RUN), F.lit(0))).alias("run"))
    named = F.concat(F.coalesce(F.col("k").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    checked = runs.withColumn("h", F.crc32(named.cast("binary")))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = checked.select(F.when(F.col("h") % DELETE_EVERY == 0, shorter).otherwise(F.col("run")).alias("word"))
    long_enough = words.where(F.char_length("word") >= least_letters)
    return long_enough.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class Acceptor:
    """Minimal deterministic automaton of sorted distinct words; states are numbers, state 0 is the initial one."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        register: dict[tuple, int] = {}
        path, before = [0], ""

        def close(depth: int) -> None:
            """States behind the common prefix change no more: each gives way to an equal one registered before."""
            while len(path) > depth + 1:
                state = path.pop()
                known = register.setdefault((self.final[state], tuple(self.arcs[state].items())), state)
                if known != state:
                    self.arcs[path[-1]][before[len(path) - 1]] = known

        for word in words:
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            close(shared)
            for letter in word[shared:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[path[-1]][letter] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            self.final[path[-1]] = True
            before = word
        close(0)

    def states(self) -> list[int]:
        seen, waiting = {0}, [0]
        while waiting:
            for state in self.arcs[waiting.pop()].values():
                if state not in seen:
                    seen.add(state)
                    waiting.append(state)
        return list(seen)

    def shared_endings(self, p: int, q: int, but: str = "") -> Iterator[str]:
        """Words accepted from both states: the composition behind the edit.  None that starts with ``but``."""
        waiting = [(p, q, "")]
        while waiting:
            p, q, read = waiting.pop()
            if self.final[p] and self.final[q]:
                yield read
            fewer, other = (p, q) if len(self.arcs[p]) <= len(self.arcs[q]) else (q, p)
            for letter, to in self.arcs[fewer].items():
                if letter in self.arcs[other] and (read or letter != but):
                    waiting.append((to, self.arcs[other][letter], read + letter))

    def edits(self, state: int) -> Iterator[tuple[str, str]]:
        """Pairs of endings from a state whose first letter is the edit.

        A letter left out of a run of equal letters is taken as the last one of them, so every pair has one path.
        """
        arcs = self.arcs[state]
        for letter, to in arcs.items():
            for ending in self.shared_endings(to, state, but=letter):
                yield letter + ending, ending
        for (a, p), (b, q) in combinations(arcs.items(), 2):
            for ending in self.shared_endings(p, q):
                yield a + ending, b + ending


def near_pairs(words: list[str]) -> Iterator[tuple[str, str]]:
    """Every pair of sorted distinct words that one inserted, deleted or replaced letter tells apart, once."""
    acceptor = Acceptor(words)
    states = acceptor.states()
    into: dict[int, list[tuple[int, str]]] = defaultdict(list)
    for state in states:
        for letter, to in acceptor.arcs[state].items():
            into[to].append((state, letter))
    for state in states:
        found = list(acceptor.edits(state))
        waiting = [(state, "")] if found else []
        while waiting:  # all that can be read up to the edit, backwards
            at, read = waiting.pop()
            if at == 0:
                for u, v in found:
                    yield read + u, read + v
            waiting += [(source, letter + read) for source, letter in into[at]]


def _compose(batches: Batches) -> Made:
    """Near pairs of every block; rows come sorted by block and word, and only one block is held."""
    def pairs(length: int, words: list[str], counts: list[int]) -> list[tuple]:
        n = dict(zip(words, counts))
        return [(u, v, n[u], n[v]) if u < v else (v, u, n[v], n[u]) for u, v in near_pairs(list(n))
                if len(u) == length or len(v) == length]

    words, counts, block, length = [], [], None, 0
    for batch in batches:
        blocks, lengths = batch.column("block").to_numpy(), batch.column("length").to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(lengths) != 0)) + 1).tolist(), len(blocks)]
        found = []
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if (block, length) != (blocks[a], lengths[a]):
                if len(words) > 1:
                    found += pairs(length, words, counts)
                words, counts, block, length = [], [], blocks[a], lengths[a]
            words += batch.column("word").slice(a, b - a).to_pylist()
            counts += batch.column("n").slice(a, b - a).to_pylist()
            if len(found) > 100_000:
                yield record(_PAIRS, *zip(*found))
                found = []
        if found:
            yield record(_PAIRS, *zip(*found))
    if len(words) > 1:
        found = pairs(length, words, counts)
        if found:
            yield record(_PAIRS, *zip(*found))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row in two blocks: by one more half of what is between its head and its tail, at either side."""
    between = F.col("length") - F.col("head") - F.col("tail")
    front = F.floor(between / 2).cast("int")
    sides = F.array(F.struct((F.col("head") + front).alias("head"), F.col("tail").alias("tail")),
                    F.struct(F.col("head").alias("head"), (F.col("tail") + between - front).alias("tail")))
    dealt = rows.select("word", "n", "length", F.explode(sides).alias("s")).select("word", "n", "length", "s.head", "s.tail")
    known = F.xxhash64("length", "head", "tail", F.substring("word", F.lit(1), F.col("head")),
                       F.substring("word", F.char_length("word") - F.col("tail") + 1, F.col("tail")))
    return dealt.withColumn("block", known)


def _blocks(words: DataFrame, least_letters: int, split_letters: int) -> DataFrame:
    """(block, length, word, n): words of that length and one more which share a head or a tail."""
    size = F.char_length("word")
    lengths = F.when(size > least_letters, F.array(size, size - 1)).otherwise(F.array(size))
    ready = None
    rows = _halved(words.select("word", "n", F.explode(lengths).alias("length"), F.lit(0).alias("head"), F.lit(0).alias("tail")))
    while True:
        large = cut(rows.groupBy("block").agg(
            F.sum(F.char_length("word")).alias("letters"), F.count("*").alias("words"),
            F.max(F.col("length") - F.col("head") - F.col("tail")).alias("between"),
        ).where((F.col("letters") > split_letters) & (F.col("words") > 2) & (F.col("between") > 1)).select("block"))
        if large.isEmpty():
            return rows if ready is None else ready.unionByName(rows)
        # Large blocks are dealt by a plain join: its rows come from hash partitions or, if few are large, are broadcast by Spark.
        rest = rows.join(large, "block", "left_anti")
        ready = rest if ready is None else ready.unionByName(rest)
        rows = cut(_halved(rows.join(large, "block", "left_semi")))


def near(words: DataFrame, least_letters: int = LEAST_LETTERS, split_letters: int = SPLIT_LETTERS) -> DataFrame:
    """(u, v, n_u, n_v) of every pair of near words of (word, n), u before v.  Words are distinct and have the least length."""
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _blocks(words, least_letters, split_letters).select("block", "length", "word", "n")
    return rows.repartition(tasks, "block").sortWithinPartitions("block", "length", "word").mapInArrow(
        _compose, _PAIRS_DDL).dropDuplicates(["u", "v"])


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form.  The distance to the root halves with every round."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("__w"), F.col("root").alias("__r"))
        moved = cut(at.join(on, at["root"] == on["__w"], "left").select("word", F.coalesce("__r", "root").alias("root"),
                                                                      F.col("__r").isNotNull().alias("__moved")))
        if moved.where("__moved").isEmpty():
            return at
        at = moved.drop("__moved")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS,
             least_count: int = LEAST_COUNT, ratio: int = FORM_RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every frequent word.

    Two words are near if one inserted, deleted or replaced letter tells them apart.  A word's form is its near word
    with the largest n, the first in code-point order of several, if that is at least ``ratio`` times the word's own n;
    else null.  Its root is the last word reached by following forms, itself without a form.  Null and empty texts have
    no words; texts of any length are taken whole; repeated rows count each; a null key reads as an empty one.  Without
    frequent words there are no rows.  Other columns are not read.
    """
    if least_letters < 2:
        raise ValueError("least_letters must be at least 2")
    if ratio < 2:
        raise ValueError("ratio must be at least 2, or forms could go in circles")
    words = cut(vocabulary(docs, key, text, least_letters, least_count))
    pairs = near(words, least_letters)
    ends = F.explode(F.array(F.struct(F.col("u").alias("word"), F.col("v").alias("near"), F.col("n_v").alias("n")),
                             F.struct(F.col("v").alias("word"), F.col("u").alias("near"), F.col("n_u").alias("n"))))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("near")))
    most = pairs.select(ends.alias("e")).select("e.*").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(most, "word", "left")
    is_form: Column = -F.col("best.less") >= ratio * F.col("n")
    found = cut(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
