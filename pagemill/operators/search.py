"""Search in document text: substring, whole word and regular expression, with positions and context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.sources.layout import text_lines


def substring_matches(lines: DataFrame, term: str, ignore_case: bool = True, overlapping: bool = False) -> DataFrame:
    """lines (…, text) with one row for each match: start (1-based) and length in the text as it is.

    Text and term are compared in their matching form, so ligatures, presentation forms, marks and ignorable characters do not hide a match.
    """
    needle = T.fold_text(term)
    needle = needle.lower() if ignore_case else needle
    n = len(needle)
    spread = T.with_matching_form(lines)
    haystack = F.lower("form.folded") if ignore_case else F.col("form.folded")
    hits = spread.where(F.contains(haystack, F.lit(needle))).withColumn("_s", F.explode(T.positions(haystack, needle, overlapping)))
    at, last = F.col("form.at"), F.length("text") + 1
    start = F.coalesce(F.get(at, F.col("_s") - 1), F.col("_s"))
    stop = F.when(at.isNull(), F.col("_s") + n).otherwise(F.greatest(F.coalesce(F.get(at, F.col("_s") + n - 1), last), F.get(at, F.col("_s") + n - 2) + 1))
    return hits.select(*lines.columns, start.alias("start"), (stop - start).alias("length"))


def search(docs: DataFrame, term: str, ignore_case: bool = True, width: int = 30) -> DataFrame:
    """(doc_id, page_no, line_no, start, first_word, last_word, context) of a term; lines without it are gone before words are made.

    The words are those that the match overlaps first and last, read from the text around it. A match that overlaps no word (only
    blanks) is dropped. Null texts match nothing.
    """
    keys = ["doc_id", "page_no", "line_no"]
    hits = substring_matches(text_lines(docs).select(*keys, "text"), term, ignore_case)
    matched = F.substring("text", F.col("start"), F.col("length"))
    head = F.reverse(F.regexp_extract(F.reverse(F.substring("text", F.lit(1), F.col("start") - 1)), r"^(\S*)", 1))
    tail = F.regexp_extract(F.substring("text", F.col("start") + F.col("length"), F.length("text")), r"^(\S*)", 1)
    whole = F.concat(F.when(matched.rlike(r"^\S"), head).otherwise(""), matched, F.when(matched.rlike(r"\S$"), tail).otherwise(""))
    found = hits.withColumn("_w", F.filter(F.split(whole, r"\s+"), lambda w: w != "")).where(F.size("_w") > 0)
    return found.select(*keys, "start", F.element_at("_w", 1).alias("first_word"), F.element_at("_w", -1).alias("last_word"), T.context(F.col("text"), F.col("start"), F.col("length"), width).alias("context"))


def regex_matches(lines: DataFrame, pattern: str) -> DataFrame:
    """lines with one row for each match of a regular expression in the matching form: its number in the line (from 0) and its text."""
    pattern = T.fold_text(pattern)
    folded = lines.withColumn("_h", T.fold(F.col("text")))
    return folded.where(F.col("_h").rlike(pattern)).select(*lines.columns, F.posexplode(F.regexp_extract_all("_h", F.lit(f"({pattern})"), F.lit(1))).alias("match_no", "matched"))
