"""Redaction in matching form and to a fixed point."""

import random

import pytest

from pagemill.functions import text as T
from pagemill.operators import redact, tooling

LINES = "doc_id long, text string"


MASKED = [
    ("a ﬁle", "file", False, 1, "a ###"),
    ("a ﬁle", "f", False, 1, "a #le"),
    ("a ﬁle", "i", False, 1, "a #le"),
    ("café x", "café", False, 1, "##### x"),
    ("café x", "café", False, 1, "#### x"),
    ("café", "caf", False, 1, "###é"),
    ("éfe", "fe", False, 1, "é##"),
    ("aaa", "aa", False, 2, "###"),
    ("aaa baa", "aa", False, 3, "### b##"),
    ("The the", "the", False, 1, "The ###"),
    ("The the", "the", True, 2, "### ###"),
    ("don’t–go", "don't-go", False, 1, "########"),
    ("a.b axb", "a.b", False, 1, "### axb"),
    ("\\E a\\Eb", "a\\Eb", False, 1, "\\E ####"),
    (None, "a", False, 0, None),
    ("", "a", False, 0, ""),
    ("abc", "", False, 0, "abc"),
    ("so­ft", "soft", False, 1, "#####"),
]


def test_masked_letters(spark):
    rows = None
    for i, (text, term, ignore_case, _, _) in enumerate(MASKED):
        one = redact.redacted_lines(spark.createDataFrame([(i, text)], LINES), term, "#", ignore_case)
        rows = one if rows is None else rows.unionByName(one)
    assert {r.doc_id: (r.n_matches, r.redacted) for r in rows.collect()} == {i: case[3:] for i, case in enumerate(MASKED)}


def _plain(text, terms, passes):
    """The plain rule on one line without characters that fold: (redacted, n_matches, passes, swept)."""
    n, done = 0, 0
    for _ in range(passes + 1):
        low = text.lower()
        hits = [(i, i + len(t)) for t in terms for i in range(len(low)) if low.startswith(t, i)]
        if not hits:
            return text, n, done, False
        n += len(hits)
        if done == passes:
            return "", n, done, True
        text, done = "".join(c for i, c in enumerate(text) if not any(a <= i < z for a, z in hits)), done + 1
    raise AssertionError


@pytest.mark.parametrize("passes", [0, 1, 3, 10])
def test_fixed_point_against_the_plain_rule(spark, passes):
    rng = random.Random(passes)
    rows = [(i, "".join(rng.choice("aAbc") for _ in range(rng.randint(0, 40)))) for i in range(120)] + [(500, "a" * 15 + "b" * 15), (501, "a" * 5 + "b" * 5), (501, "a" * 5 + "b" * 5), (502, "")]
    found = redact.redact_to_the_end(spark.createDataFrame(rows, LINES), ["ab", "ca", "ab"], passes=passes).collect()
    assert sorted((r.doc_id, r.redacted, r.n_matches, r.passes, r.swept) for r in found) == sorted((i, *_plain(t, ["ab", "ca"], passes)) for i, t in rows)
    assert not any("ab" in r.redacted.lower() or "ca" in r.redacted.lower() for r in found)


def test_fixed_point_in_matching_form(spark):
    found = redact.redact_to_the_end(spark.createDataFrame([(1, "of ﬁﬁlele x"), (2, None), (3, "clean"), (None, "ﬁle")], LINES), ["file"]).collect()
    assert sorted(((r.doc_id or 0, r.redacted, r.n_matches, r.passes, r.swept) for r in found)) == [(0, "", 1, 1, False), (1, "of  x", 2, 2, False), (2, None, 0, 0, False), (3, "clean", 0, 0, False)]
    assert redact.redact_to_the_end(spark.createDataFrame([], LINES), ["file"]).count() == 0


def test_sources_are_searched_in_matching_form(spark):
    rows = spark.createDataFrame([(1, 1, "an oﬃce"), (2, 1, "cafés"), (3, 1, "other")], "doc_id long, page_no int, text string")
    assert [r.doc_id for r in tooling.search_sources({"page": rows}, "OFFICE").collect()] == [1]
    assert [r.text for r in tooling.search_sources({"annotation": rows}, "café").collect()] == ["[in annotation] cafés"]


def test_positions(spark):
    frame = spark.createDataFrame([("abababa",), ("xaba",), ("",), ("ab",)], "text string")
    found = frame.select(T.positions(frame["text"], "aba", overlapping=True).alias("a"), T.positions(frame["text"], "aba").alias("b")).collect()
    assert [(r.a, r.b) for r in found] == [([1, 3, 5], [1, 5]), ([2], [2]), ([], []), ([], [])]
