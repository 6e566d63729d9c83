"""Facts about text and geometry that the tables do not hold."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.functions import text as T
from pagemill.operators import audit, pages, redact, reports, words


@pytest.mark.parametrize("given, folded", [("café", "café"), ("x²", "x²"), ("①", "①"), ("℡", "℡"), ("ﬃ", "ffi"), ("a­b​", "ab"), ("a b", "a b"), ("Ａ", "A"), ("אָ", "א"), ("־", "־"), ("", "")])
def test_fold(given, folded):
    assert T.fold_text(given) == folded


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_labels(spark):
    assert _one(spark, T.running_label("A", F.lit(1234567), 6)) == "A1234567"
    assert _one(spark, T.running_label("A", F.lit(7), 3, "z")) == "A007z"
    assert [_one(spark, T.alphabetic(F.lit(n))) for n in (1, 26, 27, 28, 52, 53, 702, 703, 0, -3)] == ["A", "Z", "AA", "AB", "AZ", "BA", "ZZ", "AAA", "", ""]
    assert [_one(spark, T.roman(F.lit(n))) for n in (4, 9, 1994)] == ["IV", "IX", "MCMXCIV"]


def test_similarity(spark):
    assert _one(spark, T.bigram_jaccard(F.lit("a"), F.lit(""))) == 1.0
    assert _one(spark, T.bigram_jaccard(F.lit("abc"), F.lit("abd"))) == pytest.approx(1 / 3)
    assert _one(spark, T.coverage_ratio(F.lit("ab"), F.lit(""))) == 1.0
    assert _one(spark, T.confidence_key(F.lit("KA-9"))) == "a9"


def test_positions(spark):
    assert _one(spark, T.positions(F.lit("aaaa.a"), "aa")) == [1, 3]
    assert _one(spark, T.positions(F.lit("aaaa.a"), "aa", overlapping=True)) == [1, 2, 3]
    assert _one(spark, T.positions(F.lit("x.*y.*"), ".*")) == [2, 5]
    assert _one(spark, T.context(F.lit("0123456789"), F.lit(5), F.lit(2), 2)) == "...234567..."


def test_rectangles(spark):
    box, touching, inside = (G.rect(*map(F.lit, v)) for v in ((0, 0, 10, 10), (10, 0, 20, 10), (0, 0, 10, 5)))
    assert not _one(spark, G.intersects(box, touching))
    assert _one(spark, G.contains(box, inside))
    assert _one(spark, G.overlap_type(inside, box)) == "Full"
    assert _one(spark, G.cover_share(box, inside)) == 0.5
    assert tuple(_one(spark, G.transformed(box, 0, 1, -1, 0, 5, 0))) == (-5.0, 0.0, 5.0, 10.0)


def test_null_box_is_kept(spark):
    rows = spark.createDataFrame([(1, None), (2, (0.0, 0.0, 1.0, 1.0))], "id int, box struct<l:double,b:double,r:double,t:double>")
    assert [r.id for r in redact.without_intersecting(rows, G.rect(*map(F.lit, (0, 0, 5, 5)))).collect()] == [1]


@pytest.mark.parametrize("tiers, worst", [(("Ok", "Degraded", "Ok"), "Degraded"), (("Ok", "Severe", "Degraded"), "Severe"), (("Ok", "Unverified"), "Unverified"), (("Unverified", "Severe"), "Severe")])
def test_worst_tier(spark, tiers, worst):
    assert spark.createDataFrame([(t,) for t in tiers], "tier string").agg(audit.worst_tier(F.col("tier"))).first()[0] == worst


def test_page_confidence(spark):
    long = "abcdefghij" * 5
    rows = spark.createDataFrame([(1, long, long), (2, "", long), (3, long, None), (4, "", "ok"), (5, "", "")], "id int, extracted string, expected string")
    assert {r.id: r.tier for r in audit.page_confidence(rows).collect()} == {1: "Ok", 2: "Severe", 3: "Unverified", 4: "Ok", 5: "Ok"}


def test_words_end_at_gaps(spark):
    letters = [(1, 1, 0, c, v, (72.0 + 6 * c, 720.0, 77.0 + 6 * c, 730.0)) for c, v in enumerate("ab cd") if v != " "]
    found = words.words_from_letters(spark.createDataFrame(letters, "doc_id int, page_no int, line_no int, col int, value string, box struct<l:double,b:double,r:double,t:double>"))
    assert sorted(r.text for r in found.collect()) == ["ab", "cd"]


def test_names_and_moves(spark):
    named = pages.unique_names(spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "i int, name string").withColumn("g", F.lit(1)), "g", "name", ["i"])
    assert [r.unique_name for r in named.orderBy("i").collect()] == ["a", "a (2)", "Field1"]
    moved = pages.moved(spark.createDataFrame([(1, i) for i in range(1, 6)], "doc_id int, page_no int"), 2, 4)
    assert [r.new_page_no for r in moved.orderBy("page_no").collect()] == [1, 4, 2, 3, 5]


def test_empty_requirement_matches_nothing(spark):
    files = spark.createDataFrame([("f", ["a"])], "file string, features array<string>")
    needs = spark.createDataFrame([("r", [], "all"), ("s", ["a", "b"], "any")], "requirement string, needed array<string>, mode string")
    assert [r.requirement for r in reports.requirement_matches(files, needs).collect()] == ["s"]


def test_bigram_jaccard_of_plain_and_other_texts(spark):
    pairs = [("abab", "ab"), ("naïve", "naive"), ("日本語", "本語日"), ("é", "e"), ("\U0001f600\U0001f600x", "\U0001f600x"), ("aaaa", "aab"), (None, "ab"), ("", "ab")]
    sets = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    expected = [None if a is None or b is None else len(sets(a) & sets(b)) / len(sets(a) | sets(b)) if sets(a) | sets(b) else 1.0 for a, b in pairs]
    found = spark.createDataFrame(pairs, "a string, b string").select(T.bigram_jaccard(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in found] == expected
