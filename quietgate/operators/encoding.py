"""Encoded and disguised content: base64, rot13, homoglyphs, invisible characters."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import cache
from string import ascii_lowercase as az, ascii_uppercase as AZ

from pyspark.sql import Column, DataFrame, functions as F

from quietgate import fixed_values as v
from quietgate.functions.running import rank
from quietgate.functions.text import Forms, let, rx, spans, strings, strip, with_forms

ITEM_TYPE = "array<struct<original:string,decoded:string,encoding:string,start:int,end:int>>"
PRINTABLE = r"\A[\p{L}\p{M}\p{N}\p{P}\p{S} ]*\z"
PREVIEW = 100
# Starting only at the beginning of a run finds the same runs without retrying inside every word.
BASE64_START = r"(?<![A-Za-z0-9+/])"
# A few ranges that cover every homoglyph and invisible character: quicker to test than the exact set.
MAY_BE_DISGUISED = r"[\u00a0\u00ad\u0410-\u0445\u2000-\u200f\u202a-\u202c\u2060-\u2069\ufeff\uff21-\uff23]"


def _no_items() -> Column:
    return F.array().cast(ITEM_TYPE)


def _item(original: Column, decoded: Column, encoding: str, start: Column, end: Column) -> Column:
    return F.struct(
        original.alias("original"), decoded.alias("decoded"), F.lit(encoding).alias("encoding"),
        start.cast("int").alias("start"), end.cast("int").alias("end"),
    )


def base64_items(text: Column) -> Column:
    """Runs of base64 that decode to printable UTF-8 of at least four characters."""

    def decode(run: Column) -> Column:
        missing = F.pmod(F.lit(4) - F.pmod(F.char_length(run), F.lit(4)), F.lit(4))
        padded = F.concat(run, F.repeat(F.lit("="), missing))
        return F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))

    def keep(decoded: Column) -> Column:
        return decoded.isNotNull() & (F.char_length(decoded) >= 4) & decoded.rlike(PRINTABLE)

    items = F.transform(
        spans(text, BASE64_START + v.BASE64_RUN),
        lambda s: _item(s["text"], decode(s["text"]), "base64", s["start"], s["end"]),
    )
    # Long words are runs too; places are worked out only where a run is readable.
    runs = F.regexp_extract_all(text, F.lit(BASE64_START + v.BASE64_RUN), F.lit(0))
    readable = F.exists(runs, lambda run: let(decode(run), keep))
    printable = F.filter(items, lambda i: keep(i["decoded"]))
    return F.when(text.rlike(BASE64_START + "[A-Za-z0-9+/]{16}") & readable, printable).otherwise(_no_items())


def rot13_items(forms: Forms) -> Column:
    """Letters after a ``rot13:`` marker, rotated back."""
    rotated = str.maketrans(az + AZ, az[13:] + az[:13] + AZ[13:] + AZ[:13])
    marker = rx(v.ROT13_MARKER)

    def item(match: Column) -> Column:
        # The captured letters are the tail of the whole match.
        return let(
            F.regexp_extract(match["text"], marker, 1),
            lambda tail: let(
                strip(tail),
                lambda code: _item(
                    code, F.translate(code, az + AZ, (az + AZ).translate(rotated)), "rot13",
                    match["end"] - F.char_length(tail), match["end"],
                ),
            ),
        )

    return F.when(
        forms.may_match(r"(?:rot13|rot-13)"), F.transform(spans(forms.text, marker), item)
    ).otherwise(_no_items())


def normalized(text: Column) -> Column:
    """Homoglyphs to ASCII, invisible characters dropped (characters without a partner are deleted)."""
    return F.translate(text, "".join(v.HOMOGLYPHS) + v.INVISIBLE, "".join(v.HOMOGLYPHS.values()))


def disguise_items(forms: Forms) -> Column:
    """One item with the first hundred characters when normalisation changes the text."""
    changed = let(
        normalized(forms.text),
        lambda n: F.when(
            n != forms.text,
            F.array(_item(F.substring(forms.text, 1, PREVIEW), F.substring(n, 1, PREVIEW),
                          "unicode_normalization", F.lit(0), F.lit(0))),
        ).otherwise(_no_items()),
    )
    return F.when(~forms.ascii & forms.text.rlike(MAY_BE_DISGUISED), changed).otherwise(_no_items())


def decoded_items(forms: Forms) -> Column:
    return F.concat(base64_items(forms.text), rot13_items(forms), disguise_items(forms))


def decode(df: DataFrame, text: str = "text", out: str = "decoded") -> DataFrame:
    """Add the decoded items of a text as an array column."""
    staged, forms, extra = with_forms(df, text)
    return staged.withColumn(out, decoded_items(forms)).drop(*extra)


def normalize(df: DataFrame, text: str = "text", out: str = "normalized") -> DataFrame:
    return df.withColumn(out, normalized(F.col(text)))


@cache
def script_ranges() -> dict[str, list[tuple[int, int]]]:
    """Ranges of the non-ASCII letters by the first word of their Unicode name."""
    found: dict[str, list[tuple[int, int]]] = {}
    for code in range(128, sys.maxunicode + 1):
        char = chr(code)
        if char.isalpha() and (name := unicodedata.name(char, "")):
            ranges = found.setdefault(name.split()[0], [])
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1] = (ranges[-1][0], code)
            else:
                ranges.append((code, code))
    return dict(sorted(found.items()))


def script_class(ranges: list[tuple[int, int]]) -> str:
    """Character class of some ranges, in the notation that Java and RE2 share."""
    return "[" + "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in ranges) + "]"


def _script_table() -> tuple[Column, Column, Column, int]:
    """First and last code points and names of all ranges in order, as literals, and their number."""
    listed = sorted((lo, hi, word) for word, ranges in script_ranges().items() for lo, hi in ranges)
    columns = [F.from_json(F.lit(json.dumps([r[i] for r in listed])), t) for i, t in enumerate(("array<int>", "array<int>", "array<string>"))]
    return *columns, len(listed)


def beyond_ascii(text: Column) -> Column:
    """The non-ASCII characters of a text, in order."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lit("")).otherwise(F.regexp_replace(text, "[\\x00-\\x7f]+", ""))


def scripts_of(text: Column, odd: Column) -> Column:
    """Sorted first words of the names of all letters, ``odd`` being the non-ASCII characters.

    Letters of the common Latin blocks are told by one class; each other distinct character is looked up in a table.
    """
    first, last, names, size = _script_table()
    common = script_class([r for r in script_ranges()["LATIN"] if r[1] < 0x300])

    def name(char: Column) -> Column:
        return let(F.ascii(char), lambda code: let(rank(first, code, size) - 1, lambda at: F.when(
            (at >= 0) & (F.get(last, at) >= code), F.get(names, at))))

    def with_others(rest: Column) -> Column:
        found = F.transform(F.array_distinct(F.split(rest, "")), name)
        return F.when(rest == "", latin).otherwise(F.array_sort(F.array_distinct(F.concat(latin, F.array_compact(found)))))

    latin = F.when(text.rlike("[A-Za-z]") | odd.rlike(common), strings(["LATIN"])).otherwise(strings(()))
    return F.when(odd == "", latin).otherwise(let(F.regexp_replace(odd, common + "+", ""), with_others))


def _class(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


def unicode_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Counts behind the disguise findings plus the scripts found, all native.

    Whatever is counted is outside ASCII, so one pass over the text leaves the few characters that the classes are tried on.
    """
    odd = F.col("__odd")
    glyphs, hidden = _class("".join(v.HOMOGLYPHS)), _class(v.INVISIBLE)
    codes = lambda cls: F.array_join(
        F.transform(
            F.slice(F.regexp_extract_all(odd, F.lit(cls), F.lit(0)), 1, 5),
            lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(_codepoint(c)), 4, "0")),
        ), ", ")
    return df.withColumn("__odd", beyond_ascii(F.col(text))).select(
        "*",
        F.regexp_count(odd, F.lit(glyphs)).alias("homoglyphs"),
        codes(glyphs).alias("homoglyph_codes"),
        F.regexp_count(odd, F.lit(hidden)).alias("invisibles"),
        codes(hidden).alias("invisible_codes"),
        F.regexp_count(odd, F.lit(_class(v.RIGHT_TO_LEFT))).alias("right_to_left"),
        scripts_of(F.col(text), odd).alias("scripts"),
    ).drop("__odd")


def _codepoint(char: Column) -> Column:
    """Code point of a one-character string of the basic plane."""
    return F.conv(F.hex(F.encode(char, "UTF-16BE")), 16, 10).cast("int")


def unicode_findings(df: DataFrame, text: str = "text", out: str = "findings") -> DataFrame:
    """Readable findings about disguised text."""
    counted = unicode_counts(df, text)
    scripts = F.col("scripts")
    n = lambda c: F.col(c).cast("string")
    findings = F.array_compact(F.array(
        F.when(F.col("homoglyphs") > 0, F.concat(
            F.lit("Homoglyph characters detected: "), n("homoglyphs"), F.lit(" characters ("),
            F.col("homoglyph_codes"), F.lit(")"))),
        F.when(F.col("invisibles") > 0, F.concat(
            F.lit("Invisible characters detected: "), n("invisibles"), F.lit(" characters ("),
            F.col("invisible_codes"), F.lit(")"))),
        F.when(F.size(scripts) > 2, F.concat(
            F.lit("Mixed Unicode scripts detected: "), F.array_join(scripts, ", "))),
        F.when(F.col("right_to_left") > 0, F.concat(
            F.lit("Right-to-left override characters detected: "), n("right_to_left"))),
    ))
    return counted.withColumn(out, findings)
