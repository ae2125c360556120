"""Language identification with a bidirectional gated recurrent network over bytes, trained here in numpy.

Each direction has one gate and one candidate per unit: h = z * h_before + (1 - z) * c.  Both directions together label
every byte; a document's probabilities are the means over its letters.  Texts are cut into windows that cover them
whole, and the windows of many documents run through the network side by side, so a task's memory is bounded by the
windows it runs at once.  Training unrolls windows of sampled documents and propagates back through time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from quietgate.llm.common import Batches, Made, cut, record

UNITS = 8
WINDOW = 96           # bytes that are labelled together
AT_ONCE = 2048        # windows that run side by side
SAMPLE_DOCS = 500     # labelled documents per language that training looks at, about
SAMPLE_WINDOWS = 4    # windows of each of these
WIDE = 200            # languages beyond which fewer windows run side by side
LEAST_DRAWN = 16      # training windows of each language, at least on average
STEPS, BATCH, RATE = 260, 160, 0.02
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_PREDICTED = pa.schema([("key", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("held_out", pa.bool_())])
_FOLD = 1 << 20


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Direction:
    table: np.ndarray  # (2 * UNITS, 256): input of gate and candidate for every byte
    inner: np.ndarray  # (2 * UNITS, UNITS)

    def run(self, x: np.ndarray, out: np.ndarray, kept: list | None = None) -> None:
        """States for bytes ``x`` of shape (steps, windows), written to ``out`` (steps, UNITS, windows)."""
        h = np.zeros((UNITS, x.shape[1]), np.float32)
        a = np.empty((2 * UNITS, x.shape[1]), np.float32)
        half = self.table.copy()
        inner = self.inner.copy()
        half[:UNITS] *= 0.5  # a logistic gate is a tanh of half its input
        inner[:UNITS] *= 0.5
        for t in range(len(x)):
            np.take(half, x[t], axis=1, out=a, mode="clip")
            a += inner @ h
            np.tanh(a, out=a)
            z, c = a[:UNITS], a[UNITS:]
            z *= 0.5
            z += 0.5
            if kept is not None:
                kept.append((h.copy(), z.copy(), c.copy()))
            h -= c
            h *= z
            h += c
            out[t] = h

    def back(self, x: np.ndarray, kept: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and inner weights by back-propagation through time."""
        steps = np.empty((len(x), 2 * UNITS, x.shape[1]), np.float32)
        inner = np.zeros_like(self.inner)
        dh = np.zeros((UNITS, x.shape[1]), np.float32)
        for t in range(len(x) - 1, -1, -1):
            before, z, c = kept[t]
            dh = dh + grad[t]
            da = steps[t]
            da[:UNITS] = dh * (before - c) * z * (1 - z)
            da[UNITS:] = dh * (1 - z) * (1 - c * c)
            inner += da @ before.T
            dh = dh * z + self.inner.T @ da
        flat = x.ravel()
        table = np.stack([np.bincount(flat, steps[:, r].ravel(), 256) for r in range(2 * UNITS)]).astype(np.float32)
        return table, inner


@dataclass
class Network:
    languages: list[str]
    forward: Direction
    backward: Direction
    heads: np.ndarray  # (languages, 2 * UNITS)
    bias: np.ndarray   # (languages, 1)

    @staticmethod
    def new(languages: list[str], seed: int = 7) -> Network:
        draw = np.random.default_rng(seed)
        make = lambda *shape: draw.normal(0, 0.3, shape).astype(np.float32)
        sides = [Direction(make(2 * UNITS, 256), make(2 * UNITS, UNITS)) for _ in range(2)]
        return Network(languages, *sides, make(len(languages), 2 * UNITS), np.zeros((len(languages), 1), np.float32))

    def _states(self, x: np.ndarray, kept: tuple = (None, None)) -> np.ndarray:
        both = np.empty((len(x), 2 * UNITS, x.shape[1]), np.float32)
        self.forward.run(x, both[:, :UNITS], kept[0])
        self.backward.run(x[::-1], both[::-1, UNITS:], kept[1])
        return both

    def labels(self, x: np.ndarray) -> np.ndarray:
        """Probability of every language at every byte: (steps, languages, windows)."""
        logits = self.heads @ self._states(x) + self.bias
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def train(self, windows: np.ndarray, answers: np.ndarray, seed: int = 11) -> None:
        """Adam on cross-entropy at every byte; ``windows`` (n, WINDOW) bytes, ``answers`` (n,) language numbers."""
        draw = np.random.default_rng(seed)
        parts = [self.forward.table, self.forward.inner, self.backward.table, self.backward.inner, self.heads, self.bias]
        first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        for step in range(1, STEPS + 1):
            some = draw.integers(0, len(windows), BATCH)
            x, y = np.ascontiguousarray(windows[some].T), answers[some]
            kept: tuple = ([], [])
            states = self._states(x, kept)
            d = self.heads @ states + self.bias
            d -= d.max(1, keepdims=True)
            np.exp(d, out=d)
            d /= d.sum(1, keepdims=True)
            d[:, y, np.arange(len(y))] -= 1
            d /= x.size
            ds = self.heads.T @ d
            grads = [*self.forward.back(x, kept[0], ds[:, :UNITS]), *self.backward.back(x[::-1], kept[1], ds[::-1, UNITS:]),
                     np.einsum("tkb,tub->ku", d, states), d.sum((0, 2))[:, None]]
            rate = RATE * min(1.0, 2 - 2 * step / STEPS + 0.05)
            for p, g, m, v in zip(parts, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Pooled probabilities (documents, languages) of non-empty texts."""
        counts = [-(-len(t) // WINDOW) for t in texts]
        flat = np.frombuffer(b"".join(t.ljust(n * WINDOW) for t, n in zip(texts, counts)), np.uint8).reshape(-1, WINDOW)
        owner = np.repeat(np.arange(len(texts)), counts)
        sums, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        step = max(1, AT_ONCE * WIDE // max(WIDE, len(self.languages)))
        for at in range(0, len(flat), step):
            x = np.ascontiguousarray(flat[at:at + step].T)
            lower = x | 0x20
            letter = ((lower >= 97) & (lower <= 122) | (x >= 128)).astype(np.float32)
            pooled = np.einsum("tkb,tb->bk", self.labels(x), letter)
            np.add.at(sums, owner[at:at + step], pooled)
            np.add.at(letters, owner[at:at + step], letter.sum(0))
        return sums / np.maximum(letters, 1)[:, None]


def _windows_of(text: bytes, count: int) -> list[bytes]:
    """Evenly spaced windows of a text; a short text is one window, filled up with spaces."""
    if len(text) <= WINDOW:
        return [text.ljust(WINDOW)]
    places = np.linspace(0, len(text) - WINDOW, min(count, len(text) // WINDOW)).astype(int)
    return [text[p:p + WINDOW] for p in dict.fromkeys(places)]


def _sampled(batches: Batches) -> Made:
    schema = pa.schema([("lang", pa.string()), ("window", pa.binary())])
    for batch in batches:
        langs, found = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if _LETTER.search(text):
                some = _windows_of(text.encode(), SAMPLE_WINDOWS)
                found += some
                langs += [lang] * len(some)
        yield record(schema, langs, found)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", seen: Column | None = None) -> Network | None:
    """Train on about SAMPLE_DOCS documents of each language, chosen by a hash of their key; None if there are none."""
    usable = F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull()
    rows = docs.where(usable if seen is None else usable & seen).select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    # One row a language, all of which have weights and a sample on the driver too.
    shares = cut(rows.groupBy("lang").count().select("lang", (F.floor(F.lit(SAMPLE_DOCS * _FOLD) / F.col("count")) + 1).alias("share")))
    if shares.isEmpty():
        return None
    chosen = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("key"), F.lit(_FOLD)) < F.col("share")).select("key", "text", "lang")
    sample = sorted(map(tuple, chosen.mapInArrow(_sampled, "lang string, window binary").collect()))
    if not sample:
        return None
    names = sorted({r[0] for r in sample})
    network = Network.new(names)
    if len(names) > 1:
        number = {name: i for i, name in enumerate(names)}
        answers = np.array([number[r[0]] for r in sample])
        weight = 1 / np.bincount(answers)[answers]  # each language as often as another
        draw = np.random.default_rng(3).choice(len(sample), max(8192, LEAST_DRAWN * len(names)), p=weight / weight.sum())
        windows = np.frombuffer(b"".join(bytes(r[1]) for r in sample), np.uint8).reshape(-1, WINDOW)
        network.train(windows[draw], answers[draw])
    return network


def _predicted(network):
    def run(batches: Batches) -> Made:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = some.column("text").to_pylist()
                known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if network.value else []
                langs: list[str] = [UNKNOWN] * len(texts)
                scores = np.zeros(len(texts))
                if known:
                    p = network.value.documents([texts[i].encode() for i in known])
                    best = p.argmax(1)
                    scores[known] = np.minimum(p[np.arange(len(known)), best], 1.0)
                    for i, b in zip(known, best):
                        langs[i] = network.value.languages[b]
                yield record(_PREDICTED, some.column("key"), langs, scores, some.column("held_out"))
    return run


def predict(docs: DataFrame, network: Network | None, key: str = "doc_id", text: str = "text", held_out: Column | None = None) -> DataFrame:
    """(key, lang_pred, score, held_out) of every row, from its whole text alone.

    Null texts and texts without a letter, and all texts if nothing was learned, are ``und`` with score 0.  Repeated rows
    are labelled each, a null key stays null, and an empty table gives no rows.  Of equally likely languages the first by
    name is taken; texts of any length are read whole; other columns are not read.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"),
                       (F.lit(False) if held_out is None else held_out).alias("held_out"))
    model = docs.sparkSession.sparkContext.broadcast(network)  # a few thousand weights per language
    made = rows.mapInArrow(_predicted(model), "key bigint, lang_pred string, score double, held_out boolean")
    return made.withColumnRenamed("key", key)
