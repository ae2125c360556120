"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Built-in functions only.  Candidates come from strict patterns (the base, always kept) and from broader ones (written-out
addresses, numbers without a country code, numbers that fail a check).  Five labelers vote -1, 0 or 1 on each: format,
check, gazetteer, context and boundary.  The votes of the whole corpus are counted per kind and vote pattern, at most
4 * 3^5 rows however large the corpus is.  From these counts expectation-maximisation estimates how reliable each
labeler is for each kind, and its posteriors train the span classifier, a logistic regression on the votes.

Patterns are written so that they cannot backtrack over a run of characters more than once: a match starts where a run
starts or where the previous match ended, and repeated groups are possessive.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from quietgate.functions.text import let, replace_from_right, running, spans
from quietgate.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("format", "check", "gazetteer", "context", "boundary")
ACCEPT = 0.5

_LOCAL = "[A-Za-z0-9._%+-]"
_OCTET = "(?:0++|0*+(?:[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5]))"
#: kind, strict, pattern, literal that a match contains ("" for none).
PATTERNS = (
    ("email", True, rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", True, r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ""),
    ("card", True, r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", ""),
    ("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    ("email", False, rf"(?i)(?<!{_LOCAL}){_LOCAL}{{1,64}}+ ?(?:\(at\)|\[at\]|\{{at\}}| at ) ?[A-Za-z0-9-]{{1,63}}+ ?"
                     r"(?:\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z]{2,24}+", "dot"),
    ("ip", False, r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", ":"),
    ("phone", False, r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])", ""),
)
#: Gazetteers and cue words: fixed values.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "co", "de", "fr", "es", "it", "nl", "uk", "eu", "ch", "at", "be", "us", "ca")
CARD_ISSUER = r"^(?:4|5[1-5]|2[2-7]|3[47]|30|36|38|35|6011|64|65|62)"
RESERVED_IP = r"^(?:0+|127|22[4-9]|2[3-5][0-9])\."
DIAL_CODE = r"^(?:1[2-9]|2[0-9]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1-9]|9[0-9])"
CUES = {
    "email": r"(?i)(?:mail|contact|write|reach|kontakt|correo|courriel)",
    "ip": r"(?i)(?:\bip\b|host|server|address|adresse|client|from)",
    "card": r"(?i)(?:card|visa|credit|payment|karte|carte|tarjeta)",
    "phone": r"(?i)(?:tel|phone|call|fax|mobil|cell|anruf|appel)",
}
COUNTER_CUES = r"(?i)(?:version|isbn|order|invoice|ref\b|page|section|serial|build)"


def _first_hit(text: Column, pattern: str, needs: str) -> Column:
    found = spans(text, pattern)
    return found if not needs else F.when(
        F.lower(text).contains(needs) if needs.isalpha() else text.contains(needs), found).otherwise(
        F.array().cast("array<struct<text:string,start:int,end:int>>"))


def _around(text: Column, pattern: str, found: Column) -> Column:
    """Matches with the 40 characters before and the character after each: cut from the gaps between matches."""
    gaps = F.split(text, pattern, -1)
    return F.when(F.size(found) > 0, let(gaps, lambda g: F.transform(found, lambda s, i: F.struct(
        s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"),
        F.right(F.get(g, i), F.lit(40)).alias("before"), F.left(F.get(g, i + 1), F.lit(1)).alias("after")))))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, x: Column) -> Column:
    """What a strict match must also satisfy."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return x.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    n = F.length(_digits(x))
    if kind == "phone":
        return n.between(10, 15)
    return n.between(14, 19) & F.call_function("luhn_check", F.when(n.between(14, 19), _digits(x)).otherwise("1"))


def _vote(yes: Column, otherwise: int = -1) -> Column:
    return F.when(yes, 1).otherwise(otherwise)


def _votes(kind: str, strict: bool, s: Column, ok: Column) -> list[Column]:
    x, digits = s["text"], _digits(s["text"])
    if kind == "email":
        domain = F.lower(F.regexp_extract(x, r"([A-Za-z0-9-]+)$", 1))
        check, known = _vote(domain.rlike("^[a-z]{2,24}$")), _vote(domain.isin(*TOP_DOMAINS), 0)
    elif kind == "ip":
        check, known = _vote(ok), _vote(~x.rlike(RESERVED_IP))
    elif kind == "card":
        check, known = _vote(ok), _vote(digits.rlike(CARD_ISSUER))
    else:
        check = _vote(F.length(digits).between(10, 15))
        known = _vote(digits.rlike(DIAL_CODE if strict else "^[2-9]"))
    context = F.when(s["before"].rlike(CUES[kind]), 1).when(s["before"].rlike(COUNTER_CUES), -1).otherwise(0)
    inside = s["before"].rlike("[A-Za-z0-9]$") | s["after"].rlike("^[A-Za-z0-9]")
    return [_vote(ok if strict else F.lit(False), 0), check, known, context, _vote(~inside)]


def _candidates(text: Column, kind: str, strict: bool, pattern: str, needs: str) -> Column:
    """(start, kind, end, base, votes) of the matches of one pattern; votes are digits in base 3.

    A strict match that fails its check is no base span; a card number that fails stays a candidate, other kinds drop it.
    """
    found = let(_first_hit(text, pattern, needs), lambda f: _around(text, pattern, f))

    def row(s: Column) -> Column:
        ok = _valid(kind, s["text"]) if strict else F.lit(True)
        code = sum(((v + 1) * 3 ** i for i, v in enumerate(_votes(kind, strict, s, ok))), F.lit(0))
        return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"),
                        (ok if strict else F.lit(False)).alias("base"), code.cast("int").alias("votes"))

    kept = F.filter(found, lambda s: F.length(_digits(s["text"])).between(13, 19) if kind == "card" else
                    _valid(kind, s["text"]) if strict else F.lit(True))
    return F.coalesce(F.transform(kept, row), F.array().cast("array<struct<start:int,kind:int,end:int,base:boolean,votes:int>>"))


def candidates(docs: DataFrame, text: str = "text", out: str = "candidates") -> DataFrame:
    """Add all candidate spans of every whole text, by start and kind; offsets are code points, ends exclusive."""
    whole = F.coalesce(F.col(text), F.lit(""))
    names = [f"__found{i}" for i in range(len(PATTERNS))]
    staged = docs.select("*", *(F.explode_outer(F.array(_candidates(whole, *p))).alias(n) for n, p in zip(names[:1], PATTERNS)))
    for name, pattern in zip(names[1:], PATTERNS[1:]):
        staged = staged.select("*", F.explode_outer(F.array(_candidates(whole, *pattern))).alias(name))
    return staged.withColumn(out, F.array_sort(F.flatten(F.array(*names)))).drop(*names)


@dataclass
class Classifier:
    """Weights of the votes: one for every kind, labeler and vote; and how reliable the labelers were found to be."""

    bias: list[float]
    weights: list[float]  # index: (kind * labelers + labeler) * 3 + vote + 1
    reliability: dict[tuple[str, str], float] = field(default_factory=dict)

    def score(self, span: Column) -> Column:
        """Probability that a span is personal data."""
        table = F.array(*(F.lit(w) for w in self.weights))
        total = F.get(F.array(*(F.lit(b) for b in self.bias)), span["kind"])
        for i in range(len(LABELERS)):
            vote = F.floor(span["votes"] / 3 ** i).cast("int") % 3
            total = total + F.get(table, (span["kind"] * len(LABELERS) + i) * 3 + vote)
        return 1 / (1 + F.exp(-total))


Counts = Sequence[tuple[int, tuple[int, ...], int]]  # kind, votes in 0..2, how many spans


def _em(counts: Counts, steps: int = 30) -> tuple[dict, dict]:
    """Posterior of every (kind, votes), and P(vote | class) per kind, labeler and class: two classes, votes independent."""
    posterior = {(k, v): 1 / (1 + math.exp(-sum(x - 1 for x in v))) for k, v, _ in counts}
    tables: dict = {}
    for _ in range(steps):
        mass = {(k, c): 1.0 for k in range(len(KINDS)) for c in (0, 1)}
        tables = {(k, i, c): [1.0 + (c == 1 and x == 2) + (c == 0 and x == 0) for x in range(3)]  # a labeler is rather right than wrong
                  for k in range(len(KINDS)) for i in range(len(LABELERS)) for c in (0, 1)}
        for k, v, n in counts:
            for c, share in ((1, posterior[k, v]), (0, 1 - posterior[k, v])):
                mass[k, c] += n * share
                for i, x in enumerate(v):
                    tables[k, i, c][x] += n * share
        tables = {key: [x / sum(t) for x in t] for key, t in tables.items()}
        for k, v, _ in counts:
            odds = math.log(mass[k, 1] / mass[k, 0]) + sum(
                math.log(tables[k, i, 1][x] / tables[k, i, 0][x]) for i, x in enumerate(v))
            posterior[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return posterior, tables


def train(counts: Counts, steps: int = 300, rate: float = 0.3, decay: float = 1e-3) -> Classifier:
    """Classifier from counted votes; without counts, each vote counts as much as another."""
    width = len(LABELERS)
    bias = [0.0] * len(KINDS)
    weights = [float(vote - 1) for _ in range(len(KINDS) * width) for vote in range(3)]
    if not counts:
        return Classifier(bias, weights)
    posterior, tables = _em(counts)
    heft = {(k, v): math.log1p(n) for k, v, n in counts}
    total = sum(heft.values())
    for _ in range(steps):
        db, dw = [0.0] * len(bias), [decay * w for w in weights]
        for k, v, _n in counts:
            at = [(k * width + i) * 3 + x for i, x in enumerate(v)]
            z = bias[k] + sum(weights[j] for j in at)
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - posterior[k, v]) * heft[k, v] / total
            db[k] += error
            for j in at:
                dw[j] += error
        bias = [b - rate * d * 10 for b, d in zip(bias, db)]
        weights = [w - rate * d * 10 for w, d in zip(weights, dw)]
    right = {(KINDS[k], LABELERS[i]): tables[k, i, 1][2] / (tables[k, i, 1][2] + tables[k, i, 0][2])
             for k, i in itertools.product(range(len(KINDS)), range(width))}
    return Classifier(bias, weights, right)


def fit(found: DataFrame, column: str = "candidates") -> Classifier:
    """Count the votes of all spans and train on the counts."""
    rows = found.select(F.explode(column).alias("s")).groupBy("s.kind", "s.votes").count().collect()  # 972 rows at most
    split = lambda code: tuple(code // 3 ** i % 3 for i in range(len(LABELERS)))
    return train(sorted((k, split(v), n) for k, v, n in rows))


def accepted(column: Column, classifier: Classifier) -> Column:
    """Base spans, and other candidates that the classifier accepts and that overlap no base span and none that starts before."""
    reached = "struct<start:int,before:int,base:int,every:int>"
    zero = F.struct(F.lit(-1).alias("start"), F.lit(0).alias("before"), F.lit(0).alias("base"), F.lit(0).alias("every")).cast(reached)

    def before(state: Column, s: Column) -> Column:
        """Where the spans that start before this one end at most."""
        return F.when(s["start"] == state["start"], state["before"]).otherwise(state["every"])

    def onward(state: Column, s: Column) -> Column:
        return F.struct(
            s["start"].alias("start"), before(state, s).alias("before"),
            F.when(s["base"], F.greatest(state["base"], s["end"])).otherwise(state["base"]).alias("base"),
            F.greatest(state["every"], s["end"]).alias("every")).cast(reached)

    def kept(all_: Column) -> Column:
        ends = running(all_, zero, onward, lambda state, s: F.greatest(before(state, s), state["base"]), "int")
        never = F.lit((1 << 31) - 1)
        next_base = F.reverse(running(F.reverse(all_), never, lambda state, s: F.when(s["base"], s["start"]).otherwise(state), lambda state, s: state, "int"))
        marked = F.zip_with(all_, F.zip_with(ends, next_base, lambda e, n: F.struct(e.alias("e"), n.alias("n"))), lambda s, x: F.struct(
            s.alias("s"), (s["base"] | (x["e"] <= s["start"]) & (x["n"] >= s["end"])).alias("free")))
        return F.transform(F.filter(marked, lambda m: m["free"]), lambda m: m["s"])

    chosen = F.filter(column, lambda s: s["base"] | (classifier.score(s) >= ACCEPT))
    # Only where something was added is there anything to clear away.
    return let(chosen, lambda c: F.when(F.exists(c, lambda s: ~s["base"]), kept(c)).otherwise(c))


def _listed(column: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    The counts and the digest are those of the base spans; ``spans`` lists base and added spans as kind:start:end.  Null
    and empty texts have none; repeated rows are searched each; a null key stays null; an empty table gives no rows.
    Texts of any length are searched whole; other columns are not read.
    """
    found = cut(candidates(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")), "__text").select("__key", "candidates"))
    classifier = fit(found)
    base = F.filter("candidates", lambda s: s["base"])

    def count(kind: int) -> Column:
        return F.size(F.filter("candidates", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(F.col("__key").alias(key), *counts, F.sha2(_listed(base), 256).alias("base_sha256"),
                        _listed(accepted(F.col("candidates"), classifier)).alias("spans"))


def merged(column: Column) -> Column:
    """Spans by start with those that overlap made one: it has the kind of the outermost, which starts first and of these ends last."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    plain = F.transform(column, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    def add(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = (s["start"] == last["start"]) & (s["end"] > last["end"])
        both = F.struct(last["start"].alias("start"), F.when(longer, s["kind"]).otherwise(last["kind"]).alias("kind"),
                        F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (s["start"] < last["end"]), F.concat(
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(both))).otherwise(F.array_append(done, s))

    def chosen(spans_: Column) -> Column:
        # If no span reaches into the next one, none overlap.
        clash = F.exists(F.transform(spans_, lambda s, i: (i > 0) & (s["start"] < F.get(spans_, i - 1)["end"])), lambda x: x)
        return F.when(clash, F.aggregate(spans_, none, add)).otherwise(spans_)

    return let(plain, chosen)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The table with every found span replaced by its kind in brackets; null texts stay null, other columns as they are.

    Overlapping spans are replaced as one, so the text around them stays whole.
    The votes are counted in a first pass and the texts are changed in a second one, so no text is shuffled or stored.
    """
    taken = "__candidates"
    classifier = fit(candidates(docs.select(F.col(text).alias("__text")), "__text"))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    found = candidates(docs, text, taken).withColumn(taken, F.explode_outer(F.array(merged(accepted(F.col(taken), classifier)))))
    changed = F.when(F.size(taken) > 0, replace_from_right(
        F.col(text), F.reverse(F.col(taken)), lambda s: F.get(names, s["kind"]))).otherwise(F.col(text))
    return found.withColumn(text, changed).select(*docs.columns)
