"""Lists of redaction actions, stripped fills, the safety report, arrays of letters against rows of letters."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.operators import content, graphics, redact, redaction, safety, spatial, words
from pagemill.plans import search_queries
from pagemill.sources import layout
from pagemill.storage import stored

from .test_graphics import UNIT, ops


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, "The ofﬁce of Zed\nsecond line  here\n\n tail"), (2, "abc abc\nabd"), (3, None), (4, ""), (5, "\n\n"), (6, " a\tb "), (7, "\n".join(f"line {i} of a long text" for i in range(130)))]
    return spark.createDataFrame(texts, "doc_id long, text string")


def test_words_of_pages_equal_words_from_letters(docs):
    columns = ["doc_id", "page_no", "word_no", "line_no", "first_col", "text", "box"]
    found = words.words_of_pages(layout.page_letters(docs)).select(*columns).collect()
    assert sorted(found) == sorted(words.words_from_letters(layout.letters(docs)).select(*columns).collect()) and len(found) > 600


def test_words_on_lines_equal_words_from_letters(docs, spark, tmp_path):
    columns = ["doc_id", "page_no", "word_no", "line_no", "first_col", "text"]
    docs = docs.unionByName(spark.createDataFrame([(8, "é𐤀 \u00a0x\n\x0b𐤀𐤀 ﬁ\n" * 70)], docs.schema))
    found = words.words_on_lines(layout.page_lines(docs)).select(*columns).collect()
    assert sorted(found) == sorted(words.words_from_letters(layout.letters(docs)).select(*columns).collect()) and len(found) > 900
    docs.select("*", F.lit("en").alias("lang"), F.lit("web").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    plan = search_queries.word_building(spark, f"file://{tmp_path}")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "rlike" not in plan.lower()


def test_words_of_pages_by_geometry(spark):
    rows = [(1, 1, [(0, i, v, l, b, l + 5, b + 10) for i, (v, l, b) in enumerate([("a", 0.0, 0.0), ("b", 6.0, 0.0), ("c", 20.0, 0.0), (" ", 26.0, 0.0), ("d", 32.0, 0.0), ("e", 38.0, 4.0), ("f", 44.0, 12.0)])]), (2, 1, [])]
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, letters array<struct<line_no:int,col:int,value:string,l:double,b:double,r:double,t:double>>")
    found = words.words_of_pages(pages).orderBy("word_no").collect()
    assert [(r.text, r.word_no, r.first_col, tuple(r.box)) for r in found] == [("ab", 1, 0, (0.0, 0.0, 11.0, 10.0)), ("c", 2, 2, (20.0, 0.0, 25.0, 10.0)), ("de", 3, 4, (32.0, 0.0, 43.0, 14.0)), ("f", 4, 6, (44.0, 12.0, 49.0, 22.0))]


@pytest.mark.parametrize("strategy", ["AnyOverlap", "FullyContained", "CenterPoint"])
def test_segments_of_lines_equal_segments_of_letters(docs, strategy):
    area = G.rect(F.lit(80.0), F.lit(600.0), F.lit(106.0), F.lit(715.0))
    keys = ["doc_id", "line_no"]
    found = redact.line_segments(layout.line_letters(docs).select(*keys, "letters"), keys, area, strategy).collect()
    assert sorted(found) == sorted(redact.segments(redact.removal_flags(layout.letters(docs), area, strategy), keys).collect())


def _applied(docs, wanted):
    left, counts = wanted.apply(content.layout_operators(docs), layout.page_letters(docs))
    return left, {(r.doc_id, r.page_no): r for r in counts.collect()}


def test_actions_in_order(docs):
    wanted = redaction.Redaction().area(72.0, 719.0, 80.0, 731.0).text("abc").letters(lambda x: x["value"] == "d").category("TextObject").text("")
    left, counts = _applied(docs.where("doc_id = 2"), wanted)
    r = counts[2, 1]
    assert (r.operators_removed, r.areas_redacted, r.text_occurrences, r.letters_redacted, r.categories_removed, r.all_text_removed) == (6, 1, 2, 1, 1, False)
    rows = left.orderBy("op_idx").collect()
    assert [x.name for x in rows] == ["Tf", "Td", "Tf", "Td"] + ["q", "rg", "re", "f", "Q"] * 4 and [x.op_idx for x in rows] == list(range(24))
    assert [tuple(x.box)[:3:2] for x in rows if x.name == "re"] == [(72.0, 80.0), (72.0, 89.0), (96.0, 113.0), (84.0, 89.0)]


def test_marks_on_lines_equal_those_on_letters(docs, spark):
    more = spark.createDataFrame([(8, "of\u0301ﬁce “tion” ti\ntion \u200btion e\u0301\ntiontion" * 3), (9, "\n" * 70 + "tion Z𐤀Z")], docs.schema)
    docs = docs.unionByName(more)
    wanted = redaction.Redaction().area(72.0, 719.0, 80.0, 731.0).text("tion").letters(lambda x: (x["value"] == "Z") | (x["value"] == "𐤀") & (x["l"] > 80) & (x["line_no"] > 60)).text('"tion"').category("TextObject").text("line").text("ice")
    found, plain = (sorted(map(tuple, m.collect())) for m in (wanted.marks_on_lines(layout.page_lines(docs)), wanted.marks(layout.page_letters(docs))))
    assert len(found) > 150 and found == plain


def test_first_crossing_equals_pairs(spark):
    rng = random.Random(3)
    box = lambda: (x := rng.randint(0, 60), y := rng.randint(0, 60), x + rng.choice([0, 2, 40]), y + rng.choice([0, 3, 9]))
    kind = "box struct<l:double,b:double,r:double,t:double>"
    rows = lambda n, own: [(d, 1, own(i), tuple(map(float, box())) if i % 9 else None) for d in range(4) for i in range(n)]
    given = spark.createDataFrame(rows(60, lambda i: i), f"doc_id long, page_no int, op_idx int, {kind}")
    marks = spark.createDataFrame(rows(25, lambda i: i % 3), f"doc_id long, page_no int, action int, {kind}").withColumnRenamed("box", "mark")
    found = redaction._first_crossing(given, marks).collect()
    pairs = spatial.crossing_pairs(given, marks, redaction.KEYS, "box", "mark").groupBy("doc_id", "page_no", "op_idx").agg(F.min("action").alias("action")).collect()
    assert len(found) > 50 and sorted(map(tuple, found)) == sorted(map(tuple, pairs))


def test_letters_are_taken_apart_once(docs, monkeypatch):
    """The marks are joined, counted and painted: they are stored, not made anew each time."""
    calls = []
    monkeypatch.setattr(redaction, "stored", lambda df: calls.append(df) or stored(df))
    left, counts = redaction.Redaction().text("abc").apply(content.layout_operators(docs), layout.page_lines(docs))
    assert len(calls) >= 1 and all("MapInArrow" not in d._jdf.queryExecution().executedPlan().toString() for d in (left, counts))


def test_a_match_over_two_lines_and_ligatures(docs):
    left, counts = _applied(docs.where("doc_id in (1, 2)"), redaction.Redaction().text("cab").text("office").without_markers())
    assert counts[2, 1].text_occurrences == 1 and counts[2, 1].operators_removed == 2 and counts[1, 1].text_occurrences == 1
    assert left.where("name = 'Tj'").count() == 2


def test_all_text_and_nothing(docs):
    left, counts = _applied(docs, redaction.Redaction().all_text())
    assert left.where("name = 'Tj'").count() == 0 and counts[1, 1].all_text_removed and counts[1, 1].operators_removed == 3
    left, counts = _applied(docs, redaction.Redaction())
    assert left.count() == content.layout_operators(docs).count() and all(r.operators_removed == 0 for r in counts.values())


@pytest.mark.parametrize(
    "rows, gone",
    [
        ([("re", UNIT), ("f",)], []),
        ([("g", [0.0]), ("re", UNIT), ("m",), ("f",), ("re", UNIT), ("S",), ("f",)], [1, 2, 3]),
        ([("g", [0.0]), ("f",), ("g", [1.0]), ("re", UNIT), ("B",)], []),
        ([("k", [0.0, 0, 0, 1.0]), ("re", UNIT), ("Tj", UNIT, "x"), ("b*",), ("Do",)], [1, 3]),
        ([("rg", [1.0, 1.0, 0.5]), ("rg", [None, 1.0, 1.0]), ("h",), ("F",)], [2, 3]),
    ],
)
def test_stripped_fills(rows, gone):
    assert graphics.covering_operators(ops(*rows)) == gone


def test_safety_report(spark):
    docs = spark.createDataFrame([(1, "Now  SECRET\nplan is gone", 2, 3, True, 1), (2, None, 1, 0, False, 0), (3, "x", 1, 0, False, 0)], "doc_id long, text string, n_pages int, info_fields int, has_xmp boolean, n_embedded int")
    box = "struct<l:double,b:double,r:double,t:double>"
    area = (0.0, 0.0, 10.0, 10.0)
    requests = spark.createDataFrame([(1, 1, area, "secret  Plan"), (1, 1, area, "Secret plan "), (1, 3, area, "ab"), (1, 2, area, "absent"), (2, 1, area, " "), (9, 1, area, "lost")], f"doc_id long, page_no int, area {box}, preview string")
    hidden = spark.createDataFrame([(1,), (1,)], "doc_id long")
    images = spark.createDataFrame([(1, 1, (5.0, 5.0, 20.0, 20.0)), (1, 2, (10.0, 0.0, 20.0, 5.0)), (1, 3, area), (2, 1, None)], f"doc_id long, page_no int, box {box}")
    found = {r.doc_id: r for r in safety.safety_report(docs, requests, hidden, images).collect()}
    r = found[1]
    assert (r.n_areas, r.n_areas_skipped, r.n_previews, r.n_previews_checked, r.n_previews_left, r.n_previews_short) == (4, 1, 3, 2, 1, 1)
    assert (r.content_status, r.hidden_text_status, r.image_status, r.n_hidden, r.n_image_overlaps, r.info_fields_scrubbed, r.had_xmp, r.n_embedded_before) == ("Warning", "Warning", "Warning", 2, 2, 3, True, 1)
    assert len(r.warnings) == 4 and r.has_warnings
    assert [(found[i].content_status, found[i].hidden_text_status, found[i].image_status, found[i].has_warnings) for i in (2, 3)] == [("NotChecked", "Verified", "Verified", False), ("NotChecked", "Verified", "NotChecked", False)]
    off = safety.safety_report(docs, requests, hidden, images, scrub_metadata=False, verify_text=False, audit_hidden=False, audit_images=False).where("doc_id = 1").first()
    assert (off.content_status, off.hidden_text_status, off.image_status, off.info_fields_scrubbed, off.attachments_scrubbed, off.n_hidden, off.warnings) == ("NotChecked", "NotChecked", "NotChecked", 0, False, 0, ["1 areas skipped, as their page does not exist"])
