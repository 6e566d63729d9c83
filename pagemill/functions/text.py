"""Text functions as Column expressions; offsets and lengths are in code points."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Punctuation trimmed from both ends of a word, and the quote and dash variants that match as one.
EDGE_PUNCTUATION = ".,:;!?\"'()[]"
QUOTES = "‘’‚‛′´`"
DASHES = "‐‑‒–—―−"
#: Characters that matching ignores, and vocalisation marks (ranges, and points within them that are punctuation).
IGNORED = "­​‌‍﻿"
MARK_RANGES = ((0x0591, 0x05C7), (0x0610, 0x061A), (0x064B, 0x065F), (0x0670, 0x0670), (0x06D6, 0x06DC), (0x06DF, 0x06E4), (0x06E7, 0x06E8), (0x06EA, 0x06ED))
MARKS_KEPT = (0x05BE, 0x05C0, 0x05C3, 0x05C6)


def _is_mark(c: str) -> bool:
    return any(lo <= ord(c) <= hi for lo, hi in MARK_RANGES) and ord(c) not in MARKS_KEPT


def fold_text(text: str) -> str:
    """One string's matching form: ligatures and presentation forms apart, composed, without vocalisation and ignorable
    characters, fullwidth forms as plain ones. Superscripts, circled digits and the like stay as they are."""
    if text.isascii():
        return text
    apart = "".join(unicodedata.normalize("NFKC", c) if 0xFB00 <= ord(c) <= 0xFDFF or 0xFE70 <= ord(c) <= 0xFEFC else c for c in text)
    kept = "".join(" " if c == " " else c for c in unicodedata.normalize("NFC", apart) if c not in IGNORED and not _is_mark(c))
    wide = "".join(chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else " " if c == "　" else c for c in kept)
    return unicodedata.normalize("NFC", wide)


#: Characters that folding may change, as a class: all but ASCII and the letters of the Latin blocks, which are composed already.
MAY_FOLD = "[^\\x00-\\u009F\\u00A1-\\u00AC\\u00AE-\\u024F]"
_MAY_FOLD = re.compile(MAY_FOLD)


def fold(text: Column) -> Column:
    """Matching form of a text. Only texts with characters that it may change are sent to Python, the others as nulls."""

    @F.pandas_udf(StringType())
    def folded(values: pd.Series) -> pd.Series:
        return values.map(fold_text, na_action="ignore")

    return F.coalesce(folded(F.when(text.rlike(MAY_FOLD), text)), text)


def fold_letters(letters: list[str]) -> list[str]:
    """Each letter's matching form; a mark is composed with the letter before it that is not empty, and leaves an empty one."""
    out: list[str] = []
    for letter in letters:
        form, last = fold_text(letter), next((i for i in range(len(out) - 1, -1, -1) if out[i]), None)
        if last is not None and form and all(unicodedata.combining(c) for c in form):
            out[last], form = fold_text(out[last] + form), ""
        out.append(form)
    return out


def folded_with_places(text: Column) -> Column:
    """struct(folded, at): the matching form and, for every character of it, the 1-based place of its letter; `at` is null where nothing
    changes, and then places are those of the text."""

    @F.pandas_udf("folded string, at array<int>")
    def spread(values: pd.Series) -> pd.DataFrame:
        rows = []
        for value in values:
            if value is None:
                rows.append((None, None))
                continue
            forms = fold_letters(list(value))
            rows.append(("".join(forms), [i + 1 for i, form in enumerate(forms) for _ in form]))
        return pd.DataFrame(rows, columns=["folded", "at"])

    return spread(F.when(text.rlike(MAY_FOLD), text))


def with_matching_form(rows: DataFrame, name: str = "text") -> DataFrame:
    """rows with form, struct(folded, at) as folded_with_places gives it, where `at` is null if nothing moves. Only rows with characters that
    folding may change go through Python; the others never leave the JVM."""
    plain = F.struct(F.col(name).alias("folded"), F.lit(None).cast("array<int>").alias("at"))
    odd = F.coalesce(F.col(name).rlike(MAY_FOLD), F.lit(False))
    return rows.where(odd).withColumn("form", folded_with_places(F.col(name))).unionByName(rows.where(~odd).withColumn("form", plain))


def _reach(text: Column, form: Column, n: int) -> Callable[[Column], Column]:
    """From the place of a match of n characters in the matching form to its range of letters."""

    def place(k: Column) -> Column:
        return F.coalesce(F.get(form["at"], k - 1), F.when(form["at"].isNull(), k), F.length(text) + 1)

    return lambda k: F.struct(place(k).alias("a"), F.greatest(place(k + n), place(k + n - 1) + 1).alias("z"))


def match_ranges(text: Column, form: Column, terms: list[str], ignore_case: bool) -> Column:
    """array of struct(a, z), sorted: from where to before where (1-based, in the text as it is) each place of each term reaches, overlaps included.

    Terms and text are compared in matching form, quotes and dashes as one. A match takes whole letters: a ligature that it touches, and the marks
    after its last letter.
    """
    plain = lambda c: F.translate(F.translate(c, QUOTES, "'" * len(QUOTES)), DASHES, "-" * len(DASHES))
    haystack = plain(form["folded"])
    haystack = F.lower(haystack) if ignore_case else haystack
    found = F.array().cast("array<struct<a:int,z:int>>")
    for term in dict.fromkeys(map(fold_text, terms)):
        needle = term.translate({ord(c): "'" for c in QUOTES} | {ord(c): "-" for c in DASHES})
        needle, n = (needle.lower() if ignore_case else needle), len(needle)
        if n:
            found = F.concat(found, F.when(F.contains(haystack, F.lit(needle)), F.transform(positions(haystack, needle, overlapping=True), _reach(text, form, n))).otherwise(F.array().cast("array<struct<a:int,z:int>>")))
    return F.array_sort(found)


def ranges_in(text: str, terms: list[str], ignore_case: bool) -> list[tuple[int, int]]:
    """match_ranges of one string."""
    plain = lambda s: s.translate({ord(c): "'" for c in QUOTES} | {ord(c): "-" for c in DASHES})
    folded, at = text, None
    if _MAY_FOLD.search(text):
        forms = fold_letters(list(text))
        folded, at = "".join(forms), [i + 1 for i, form in enumerate(forms) for _ in form]
    haystack = plain(folded).lower() if ignore_case else plain(folded)
    place = lambda k: k if at is None else at[k - 1] if k <= len(at) else len(text) + 1
    found = []
    for term in dict.fromkeys(map(fold_text, terms)):
        needle = plain(term).lower() if ignore_case else plain(term)
        k = haystack.find(needle) if needle else -1
        while k >= 0:
            found.append((place(k + 1), max(place(k + 1 + len(needle)), place(k + len(needle)) + 1)))
            k = haystack.find(needle, k + 1)
    return sorted(found)


def redaction_form(text: Column) -> Column:
    """Folded, quotes and dashes unified, trimmed, white space collapsed."""
    plain = F.translate(F.translate(fold(text), QUOTES, "'" * len(QUOTES)), DASHES, "-" * len(DASHES))
    return F.regexp_replace(F.trim(plain), r"\s+", " ")


def confidence_key(text: Column) -> Column:
    """Only ASCII letters and digits, lower-cased; others go before the case changes."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def letter_digit_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", ""))


def coverage_ratio(extracted: Column, expected: Column) -> Column:
    """Letters and digits extracted for each expected one; 1 when none is expected."""
    return F.coalesce(F.try_divide(letter_digit_count(extracted), F.nullif(letter_digit_count(expected), F.lit(0))), F.lit(1.0))


def _pairs(text: str) -> np.ndarray:
    """Which pairs of neighbouring characters a text has, as numbers."""
    if text.isascii():
        codes = np.frombuffer(text.encode(), np.uint8).astype(np.int64)
        held = np.flatnonzero(np.bincount((codes[:-1] << 7) | codes[1:], minlength=1)).astype(np.uint64)
        return (held >> np.uint64(7) << np.uint64(32)) | (held & np.uint64(127))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return np.unique((codes[:-1] << np.uint64(32)) | codes[1:])


def bigram_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of pairs of neighbouring characters; 1 when both texts are shorter than two, null when one is null."""

    @F.pandas_udf("double")
    def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            if x is None or y is None:
                out.append(None)
                continue
            p, q = _pairs(x), _pairs(y)
            both = len(np.intersect1d(p, q, assume_unique=True))
            whole = len(p) + len(q) - both
            out.append(both / whole if whole else 1.0)
        return pd.Series(out, dtype="Float64")

    return similarity(a, b)


def page_tier(expected_key: Column, coverage: Column, similarity: Column) -> Column:
    """Confidence tier of a page: Unverified without an expectation, Ok under 32 expected characters, else by the weaker score."""
    score = F.least(coverage, similarity)
    return F.when(expected_key.isNull(), "Unverified").when(F.length(expected_key) < 32, "Ok").when(score < 0.5, "Severe").when(score < 0.9, "Degraded").otherwise("Ok")


def context(text: Column, start: Column, length: Column, width: int = 30) -> Column:
    """The match at 1-based `start` with up to `width` characters on both sides and dots where the text goes on."""
    lo = F.greatest(start - width, F.lit(1))
    hi = F.least(start + length - 1 + width, F.length(text))
    return F.concat(F.when(lo > 1, "...").otherwise(""), F.substring(text, lo, hi - lo + 1), F.when(hi < F.length(text), "...").otherwise(""))


def running_label(prefix: str, number: Column, digits: int, suffix: str = "") -> Column:
    """prefix, number padded to at least `digits` digits (never cut), suffix."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, "0")), F.lit(suffix))


def roman(number: Column) -> Column:
    """Upper-case roman numeral of 1 to 3999."""
    fixed = [("M", 1000), ("CM", 900), ("D", 500), ("CD", 400), ("C", 100), ("XC", 90), ("L", 50), ("XL", 40), ("X", 10), ("IX", 9), ("V", 5), ("IV", 4), ("I", 1)]
    rest, parts = number, []
    for sign, value in fixed:
        parts.append(F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.concat(*parts)


def alphabetic(number: Column) -> Column:
    """A to Z, then AA, AB to AZ, BA and so on: digits of base 26 without a zero. Empty below 1."""
    letters, rest = [], number.cast("long")
    for _ in range(14):
        letters.insert(0, F.when(rest > 0, F.chr(65 + (rest - 1) % 26)).otherwise(""))
        rest = F.floor((rest - 1) / 26).cast("long")
    return F.concat(*letters)


def trim_edges(word: Column) -> Column:
    return F.btrim(word, F.lit(EDGE_PUNCTUATION))


def remove_terms(text: Column, terms: list[str]) -> Column:
    """Distinct terms of at least three characters removed one after another, case as given, then trimmed."""
    for term in dict.fromkeys(t for t in terms if len(t) >= 3):
        text = F.replace(text, F.lit(term), F.lit(""))
    return F.trim(text)


def csv_quote(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_number(number: Column) -> Column:
    """At most six digits after the point, rounded half up, without zeros at the end and, for whole numbers, without the point."""
    return F.when(number.isNotNull(), F.regexp_replace(F.format_string("%.6f", number.cast("double")), r"\.?0+$", ""))


def manifest_path(path: Column) -> Column:
    return F.replace(F.trim(path), F.lit("\\"), F.lit("/"))


def positions(text: Column, term: str, overlapping: bool = False) -> Column:
    """1-based starts of a term in a text, left to right; without overlaps unless asked for."""
    n = len(term)
    quoted = "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    if overlapping:
        # Cut before every place of the term: all pieces start with it, but for a first one that does not.
        init = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found"))
        cut = F.split(text, f"(?={quoted})", -1)
        step = lambda s, x: F.struct((s["at"] + F.length(x)).alias("at"), F.when((x != "") & ((s["at"] > 1) | F.startswith(text, F.lit(term))), F.concat(s["found"], F.array(s["at"]))).otherwise(s["found"]).alias("found"))
        return F.aggregate(cut, init, step, lambda s: s["found"])
    parts = F.split(text, quoted, -1)
    heads = F.slice(parts, F.lit(1), F.size(parts) - 1)
    init = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found"))
    return F.aggregate(heads, init, lambda s, x: F.struct((s["at"] + F.length(x) + n).alias("at"), F.concat(s["found"], F.array(s["at"] + F.length(x))).alias("found")), lambda s: s["found"])
