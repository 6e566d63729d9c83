"""The stored index against the live search, with batches added and removed."""

import os

import pytest
from pyspark.sql import functions as F

from pagemill.operators import search
from pagemill.operators.text_index import TextIndex, _postings
from pagemill.sources.layout import text_lines

FIRST = [(1, "The cat sat on the  cat\n\n  the end. \tThe"), (2, "Caﬁeld ﬁne café\nnaïve «the» (The)"), (3, None), (None, "the"), (4, ""), (5, "a a a a\naaa aaaa")]
SECOND = [(2, "second text with the cat"), (6, "mail me@x.org, or the.cat@y.org now")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    made = TextIndex(spark, f"file://{tmp_path_factory.mktemp('index')}/i", buckets=4)
    made.add(spark.createDataFrame(FIRST, "doc_id long, text string"), 0)
    return made


def _files(index):
    return {f"{d}/{x}": os.stat(f"{d}/{x}").st_mtime_ns for d, _, names in os.walk(index.path.removeprefix("file://")) for x in names}


def _live(spark, rows, term, ignore_case=True):
    lines = text_lines(spark.createDataFrame([r for r in rows if r[0] is not None], "doc_id long, text string")).select("doc_id", "line_no", "text")
    return sorted((r.doc_id, r.line_no, r.start, r.length) for r in search.substring_matches(lines, term, ignore_case).collect())


def _found(index, term, ignore_case=True):
    return sorted(map(tuple, index.substrings(term, ignore_case).collect()))


TERMS = ["the", "at", "e  c", "the cat", "t s", " the", "the ", "end. \tt", "café", "fine c", "a a", "aa"]


@pytest.mark.parametrize("ignore_case", [True, False])
def test_substrings_equal_the_live_search(spark, index, ignore_case):
    lines = text_lines(spark.createDataFrame([r for r in FIRST if r[0] is not None], "doc_id long, text string")).select("doc_id", "line_no", "text").cache()
    live = found = None
    for term in TERMS:
        one = search.substring_matches(lines, term, ignore_case).select(F.lit(term).alias("term"), "doc_id", "line_no", "start", "length")
        two = index.substrings(term, ignore_case).select(F.lit(term).alias("term"), "doc_id", "line_no", "start", "length")
        live, found = (one, two) if live is None else (live.unionByName(one), found.unionByName(two))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, live.collect()))


def test_whole_words_and_frequencies(index):
    assert sorted((r.doc_id, r.line_no, r.start, r.word) for r in index.whole_words("THE").collect()) == [(1, 0, 1, "The"), (1, 0, 16, "the"), (1, 2, 3, "the"), (1, 2, 13, "The"), (2, 1, 13, "(The)")]
    assert {(r.word, r.docs, r.occurrences) for r in index.frequencies(["the", "cat", "none"]).collect()} == {("the", 2, 5), ("cat", 1, 2)}


def test_blank_terms_find_nothing(index):
    assert index.substrings(" ").count() == 0 and index.substrings("").count() == 0


def test_only_the_words_buckets_are_read(index):
    plan = index.whole_words("cat")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("#", "") or "bucket" in plan.split("PartitionFilters")[1][:200]


def test_batches_are_only_added(spark, index, tmp_path):
    made = TextIndex(spark, f"file://{tmp_path}/i", buckets=4)
    made.add(spark.createDataFrame(FIRST, "doc_id long, text string"), 0)
    before = _files(made)
    made.add(spark.createDataFrame(SECOND, "doc_id long, text string"), 1)
    made.remove(spark.createDataFrame([(1,), (99,)], "doc_id long"), 2)
    after = _files(made)
    assert all(after[f] == t for f, t in before.items())
    now = [r for r in FIRST if r[0] not in (1, 2, None)] + SECOND
    assert sorted(r.doc_id for r in made.documents().collect()) == [2, 4, 5, 6]
    for term in ("the", "the cat", "t"):
        assert _found(made, term) == _live(spark, now, term)
    made.add(spark.createDataFrame(FIRST[:1], "doc_id long, text string"), 3)
    assert _found(made, "the") == _live(spark, FIRST[:1] + now, "the")


def test_lines_and_expressions_come_from_postings(spark, tmp_path):
    made = TextIndex(spark, f"file://{tmp_path}/i", buckets=2)
    rows = FIRST[:2] + SECOND[1:]
    made.add(spark.createDataFrame(rows, "doc_id long, text string"), 0)
    lines = {(r.doc_id, r.line_no): r.text for r in made.lines().collect()}
    assert lines[1, 0] == "The cat sat on the  cat" and lines[1, 2] == "  the end. \tThe" and (1, 1) not in lines
    pattern = r"[a-z.]+@[a-z.]+\w"
    live = search.regex_matches(text_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "line_no", "text"), pattern).drop("text").collect()
    assert sorted(made.regex(pattern, "@").collect()) == sorted(made.regex(pattern).collect()) == sorted(live) and len(live) == 2


def test_empty_index(spark, tmp_path):
    made = TextIndex(spark, f"file://{tmp_path}/i")
    made.add(spark.createDataFrame(FIRST, "doc_id long, text string").where(F.lit(False)), 0)
    assert made.substrings("a").count() == 0 and made.whole_words("a").count() == 0 and made.documents().count() == 0


def test_places_are_not_shuffled(spark, tmp_path):
    """Postings are put together where the texts are; a document's places of one word stay one row, whatever the size of the pieces."""
    docs = spark.createDataFrame([r for r in FIRST if None not in r], "doc_id long, text string")
    found = _postings(docs, most=3)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    assert len({(r.word, r.doc_id) for r in rows}) == len(rows) and sum(len(r.places) for r in rows) == 21
    assert [tuple(p)[:5] for r in rows if (r.word, r.doc_id) == ("cat", 1) for p in r.places] == [(0, 1, 5, " ", " "), (0, 5, 21, "  ", "")]


def test_repeated_ids_are_one_document(spark, tmp_path):
    made = TextIndex(spark, f"file://{tmp_path}/i", buckets=2)
    made.add(spark.createDataFrame([(1, "b the"), (1, "a the"), (2, "the the"), (2, None)], "doc_id long, text string"), 0)
    assert sorted((r.doc_id, r.start) for r in made.whole_words("the").collect()) == [(1, 3), (2, 1), (2, 5)] and made.documents().count() == 2
