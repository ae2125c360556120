"""Text helpers as native Column expressions: regex flags, spans, words, sentences, redaction folds."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from quietgate.functions.prefilter import FOLDING_TO_ASCII, anchor, needs

# Characters Python's str.strip() removes; \s of the patterns covers all but the four separators \x1c-\x1f.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)
WORD_RUN = r"[\p{L}\p{N}_]+"
SENTENCE_GAP = r"(?U)(?<=[.!?])[\s\x1c-\x1f]+"
SPAN_TYPE = "array<struct<text:string,start:int,end:int>>"


def rx(pattern: str, ignore_case: bool = True, multiline: bool = False) -> str:
    """Java form of a Python pattern: Unicode classes and folding, only ``\\n`` ends a line."""
    java = pattern.replace("(?P<", "(?<").replace("\\Z", "\\z")
    return f"(?{'i' if ignore_case else ''}{'m' if multiline else ''}udU){java}"


@dataclass(frozen=True)
class Forms:
    """A text with the derived columns that make its tests cheap."""

    text: Column
    lower: Column
    ascii: Column
    odd: Column
    digits4: Column
    known: dict[str, Column] = field(default_factory=dict)  # literals already tested, shared by all rules

    def may_have(self, word: str) -> Column:
        """Necessary for the lower-cased text to contain ``word`` (lower case)."""
        inside = max((k for k in self.known if k in word), key=len, default=None)
        return self.lower.contains(anchor(word)) if inside is None else self.known[inside]

    def has(self, word: str) -> Column:
        """The lower-cased text contains ``word`` (lower case)."""
        if word in self.known:
            return self.known[word]
        return self.may_have(word) & self.lower.contains(word)

    def may_match(self, pattern: str, ignore_case: bool = True) -> Column | None:
        """Necessary condition of ``pattern``, or None when none is known."""
        known = needs(pattern)
        tests = [_any(self.may_have(word) for word in sorted(group)) for group in known.groups]
        condition = _all(tests)
        if condition is not None and ignore_case:
            condition = self.odd | condition
        if known.digit_run >= 4:
            condition = self.digits4 if condition is None else self.digits4 & condition
        if known.non_ascii:
            condition = ~self.ascii if condition is None else ~self.ascii & condition
        return condition

    def matches(self, pattern: str, ignore_case: bool = True, multiline: bool = False) -> Column:
        """``re.search`` as a boolean, the regex guarded by its necessary literals."""
        hit = self.text.rlike(rx(pattern, ignore_case, multiline))
        condition = self.may_match(pattern, ignore_case)
        return hit if condition is None else condition & hit


def _any(tests: Iterable[Column]) -> Column | None:
    out = None
    for test in tests:
        out = test if out is None else out | test
    return out


def _all(tests: Iterable[Column]) -> Column | None:
    out = None
    for test in tests:
        out = test if out is None else out & test
    return out


any_of, all_of = _any, _all


def forms_of(text: Column) -> Forms:
    """Forms computed in place; inside a higher-order function, or where the text is used once."""
    is_ascii = F.octet_length(text) == F.char_length(text)
    return Forms(
        text,
        F.lower(text),
        is_ascii,
        ~is_ascii & text.rlike(f"[{FOLDING_TO_ASCII}]"),
        text.rlike(r"\p{Nd}{4}"),
    )


def literals_of(patterns: Iterable[str], keywords: Iterable[str] = ()) -> list[str]:
    """Literals worth testing once per text for a rule set: the most selective group of every pattern, and keywords."""
    wanted = {k.lower() for k in keywords}
    for pattern in patterns:
        wanted.update(*needs(pattern).groups[:1])
    return distinct_literals(map(anchor, wanted))


def distinct_literals(literals: Iterable[str]) -> list[str]:
    """Literals without those that contain another one: they are tested behind it, only where it occurs."""
    found = set(literals)
    return sorted(w for w in found if not any(o != w and o in w for o in found))


def with_forms(df: DataFrame, text: str, literals: Sequence[str] = (), tag: str = "__t") -> tuple[DataFrame, Forms, list[str]]:
    """Add the forms as columns of their own so that every test of a row shares them."""
    made = forms_of(F.col(text))
    names = [f"{tag}_lower", f"{tag}_ascii", f"{tag}_odd", f"{tag}_digits4"]
    out = df.select("*", *(c.alias(n) for c, n in zip((made.lower, made.ascii, made.odd, made.digits4), names)))
    known = {word: f"{tag}_has{i}" for i, word in enumerate(literals)}
    if known:
        out = out.select("*", *(F.col(names[0]).contains(word).alias(n) for word, n in known.items()))
    forms = Forms(F.col(text), *(F.col(n) for n in names), {word: F.col(n) for word, n in known.items()})
    return out, forms, [*names, *known.values()]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strings(values: Sequence[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def kept(tests: Iterable[tuple[Column, str]]) -> Column:
    """Names of the tests that hold, in order."""
    items = [F.when(test, F.lit(name)) for test, name in tests]
    return F.array_compact(F.array(*items)) if items else strings(())


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def number_text(value: Column) -> Column:
    """A double as Python writes it: 1.0, 0.35, 1e-05, 1e+16; the digits are those of Spark's own text form."""
    form = r"^(-?)([0-9]+)\.([0-9]+)E(-?[0-9]+)$"

    def written(shown: Column) -> Column:
        sign, whole, rest, power = (F.regexp_extract(shown, form, i) for i in (1, 2, 3, 4))
        exponent = power.try_cast("int")
        digits = F.concat(whole, F.when(rest == "0", "").otherwise(rest))
        size = F.char_length(digits)
        mantissa = F.concat(whole, F.when(rest == "0", "").otherwise(F.concat(F.lit("."), rest)))
        padded = F.rpad(digits, F.greatest(exponent + 1, size), "0")
        large = F.concat(F.left(padded, exponent + 1), F.lit("."), F.when(size > exponent + 1, F.substring(
            padded, exponent + 2, size)).otherwise(F.lit("0")))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
        power_text = F.concat(mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(
            F.abs(exponent).cast("string"), F.greatest(F.char_length(F.abs(exponent).cast("string")), F.lit(2)), "0"))
        plain = F.when(exponent.between(0, 15), large).when(exponent.between(-4, -1), small).otherwise(power_text)
        return (F.when(shown == "NaN", "nan").when(shown == "Infinity", "inf").when(shown == "-Infinity", "-inf")
                .when(shown.contains("E"), F.concat(sign, plain)).otherwise(shown))

    return let(value.cast("double").cast("string"), written)


def words(lowered: Column) -> Column:
    """All word runs of a lower-cased text, in order, repeats kept."""
    return F.regexp_extract_all(lowered, F.lit(WORD_RUN), F.lit(0))


def sentences(text: Column) -> Column:
    """Stripped sentences of the stripped text."""
    return F.transform(F.split(strip(text), SENTENCE_GAP), strip)


BLOCK = 128  # items per block where a step costs as much as what was built before it


def _blocks(items: Column) -> Column:
    """An array cut into blocks, so that growing or cutting something item by item stays linear for long arrays."""
    def cut(x: Column) -> Column:
        last = F.call_function("div", F.size(x) - 1, F.lit(BLOCK)).cast("int")
        numbers = F.when(F.size(x) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK)))

    return let(items, cut)  # or every block would work out all items again


def _totals_before(sizes: Column, offset: Column) -> Column:
    """What has been summed up before each of a few numbers, from ``offset`` on."""
    return F.aggregate(
        sizes, F.struct(offset.cast("int").alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")),
        lambda acc: acc["out"])


def totals_before(sizes: Column) -> Column:
    """What has been summed up before each of any number of numbers, block by block."""
    def summed(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, n: acc + n))
        return F.flatten(F.zip_with(blocks, _totals_before(sums, F.lit(0)), _totals_before))

    return let(_blocks(sizes), summed)


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], shown: Callable[[Column, Column], Column],
            kind: str) -> Column:
    """``shown(state, item)`` of every item, a ``kind`` each, with the state that the items before it left, block by block."""

    def block(part: Column, state: Column) -> Column:
        return F.aggregate(part, F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out")), lambda acc, x: F.struct(
            step(acc["state"], x).alias("state"), F.array_append(acc["out"], shown(acc["state"], x).cast(kind)).alias("out")))

    return F.aggregate(
        _blocks(items), F.struct(zero.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")),
        lambda acc, part: let(block(part, acc["state"]), lambda r: F.struct(
            r["state"].alias("state"), F.array_append(acc["out"], r["out"]).alias("out"))),
        lambda acc: F.flatten(acc["out"]))


def places(text: Column, word: Column) -> Column:
    """Where a word of letters, digits and underscores occurs in a text, from 0 on, overlapping occurrences included."""
    parts = F.split(text, F.concat(F.lit("(?="), word, F.lit(")")), -1)
    found = totals_before(F.transform(parts, F.char_length))
    # Every part but the first starts with the word; the first one does if the text does.
    return F.when(text.contains(word), F.filter(found, lambda _, i: (i > 0) | text.startswith(word))).otherwise(
        F.array().cast("array<int>"))


def _place(steps: Column, offset: Column) -> Column:
    """Offsets of the matches of one block that starts at ``offset``."""
    return F.aggregate(
        steps,
        F.struct(offset.alias("at"), F.array().cast(SPAN_TYPE).alias("out")),
        lambda acc, s: let(
            acc["at"] + F.char_length(s["g"]),
            lambda start: let(
                start + F.char_length(s["m"]),
                lambda end: F.struct(
                    end.alias("at"),
                    F.array_append(
                        acc["out"], F.struct(s["m"].alias("text"), start.alias("start"), end.alias("end"))
                    ).alias("out"),
                ),
            ),
        ),
        lambda acc: acc["out"],
    )


def _walk(found: Column, gaps: Column) -> Column:
    """Offsets of matches from the lengths of the matches and of the text between them, block by block."""
    steps = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))

    def placed(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(
            b, F.lit(0), lambda acc, s: acc + F.char_length(s["m"]) + F.char_length(s["g"])))
        return F.flatten(F.zip_with(blocks, _totals_before(sizes, F.lit(0)), _place))

    return let(_blocks(steps), placed)


def spans(text: Column, java_pattern: str) -> Column:
    """All matches with code-point offsets, end-exclusive; the second pass runs only where something matched."""
    return let(
        F.regexp_extract_all(text, F.lit(java_pattern), F.lit(0)),
        lambda found: F.when(F.size(found) > 0, _walk(found, F.split(text, java_pattern, -1)))
        .otherwise(F.array().cast(SPAN_TYPE)))


def with_spans(df: DataFrame, text: Column, patterns: Sequence[tuple[str, Column | None]], out: str) -> DataFrame:
    """All matches of many patterns as one array of (start, end, ord, text), ord being the pattern's position.

    ``patterns`` pairs a Java pattern with a necessary condition.  The regexes stay separate columns;
    only texts with a match go on, and one shared expression turns matches into offsets.
    """
    none = F.array().cast("array<string>")
    found = []
    for java, condition in patterns:
        matches = F.regexp_extract_all(text, F.lit(java), F.lit(0))
        found.append(matches if condition is None else F.when(condition, matches).otherwise(none))
    names = [f"{out}_{i}" for i in range(len(found))]
    staged = df.select("*", *(c.alias(n) for c, n in zip(found, names)))
    hit = [F.when(F.size(n) > 0, F.struct(F.lit(i).alias("ord"), F.col(n).alias("m"), F.split(text, java, -1).alias("g")))
           for i, (n, (java, _)) in enumerate(zip(names, patterns))]
    placed = F.flatten(F.transform(F.array_compact(F.array(*hit)), lambda h: F.transform(
        _walk(h["m"], h["g"]), lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), h["ord"].alias("ord"), s["text"].alias("text")))))
    return staged.withColumn(out, placed).drop(*names)


def replace_from_right(text: Column, ordered: Column, replacement: Callable[[Column], Column]) -> Column:
    """Replace spans one after the other in the given order, offsets as they were in the original text.

    ``ordered`` runs from the end of the text to its start.  Spans that do not overlap are put together
    from pieces instead, with the same result: the fold copies the whole text for every span.
    """
    folded = F.aggregate(
        ordered,
        text,
        lambda acc, s: F.concat(
            F.substring(acc, F.lit(1), s["start"]),
            replacement(s),
            F.substring(acc, s["end"] + 1, F.char_length(acc)),
        ),
    )
    pieces = F.transform(F.reverse(ordered), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), replacement(s).alias("r")))

    def joined(block: Column, since: Column) -> Column:
        """One block of pieces, cut from the part of the text it covers."""
        part = F.substring(text, since + 1, F.element_at(block, -1)["end"] - since)
        return let(part, lambda sub: F.array_join(F.transform(block, lambda s, i: let(
            F.when(i == 0, since).otherwise(F.get(block, i - 1)["end"]),
            lambda before: F.concat(F.substring(sub, before - since + 1, s["start"] - before), s["r"]))), ""))

    def assembled(spans_: Column) -> Column:
        # Every block starts where the one before it ended.
        built = let(_blocks(spans_), lambda blocks: F.array_join(F.transform(blocks, lambda b, i: joined(
            b, F.when(i == 0, F.lit(0)).otherwise(F.element_at(F.get(blocks, i - 1), -1)["end"]))), ""))
        rest = F.substring(text, F.element_at(spans_, -1)["end"] + 1, F.char_length(text))
        return F.concat(built, rest)

    def chosen(spans_: Column) -> Column:
        overlapping = F.exists(
            F.transform(spans_, lambda s, i: (i > 0) & (s["start"] < F.get(spans_, i - 1)["end"])), lambda x: x)
        return F.when(overlapping, folded).otherwise(assembled(spans_))

    return F.when(F.size(ordered) > 0, let(pieces, chosen)).otherwise(text)


def rank_of(value: Column, ranked: Sequence[str]) -> Column:
    return F.array_position(strings(ranked), value).cast("int")


def worst_of(values: Column, ranked: Sequence[str], default: str) -> Column:
    """Most severe of an array of ranked names."""
    top = F.array_max(F.transform(values, lambda v: rank_of(v, ranked)))
    return F.coalesce(F.element_at(strings(ranked), top), F.lit(default))


def fenced(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column behind a one-element explode.

    A filter on a plain projected column is pushed below the projection together with a copy of
    the column's expression, which would run every regex twice.  A filter on a generated column
    stays above it, while filters on other columns still pass through to the table scan.
    """
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode_outer(F.array(value)).alias(name))


def exploded(df: DataFrame, keep: Sequence[str], items: Column | str, position: str, item: str) -> DataFrame:
    """One row per array element.

    The outer form plus a filter on the position: the plain form makes the optimizer infer
    ``size(items) > 0`` and evaluate the expression of the array a second time.
    """
    return df.select(*keep, F.posexplode_outer(items).alias(position, item)).where(F.col(position).isNotNull())
