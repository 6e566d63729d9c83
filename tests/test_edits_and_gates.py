"""Page edits, batch errors, gates and right-to-left runs on hand-made rows and against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pagemill.operators import batch, pages, reading
from pagemill.operators import reports as R
from pagemill.plans import stream_queries
from pagemill.sources import layout


def _plain(n, edits):
    out = [(i, 0) for i in range(1, n + 1)]
    for kind, at, *rest in edits:
        if kind == "insert" and 1 <= at <= len(out) + 1:
            out.insert(at - 1, (None, 0))
        elif 1 <= at <= len(out):
            if kind == "remove" and len(out) > 1:
                out.pop(at - 1)
            elif kind == "move" and 1 <= rest[0] <= len(out):
                out.insert(rest[0] - 1, out.pop(at - 1))
            elif kind == "rotate":
                out[at - 1] = (out[at - 1][0], (out[at - 1][1] + rest[0]) % 360)
    return [(i, *x) for i, x in enumerate(out, 1)]


@pytest.mark.parametrize("seed", range(4))
def test_edits_equal_lists(spark, seed):
    rng = random.Random(seed)
    edits = []
    for _ in range(7):
        kind, at = rng.choice(["remove", "insert", "move", "rotate"]), rng.randint(0, 6)
        edits.append((kind, at, rng.randint(0, 6)) if kind == "move" else (kind, at, rng.choice([90, -90, 450])) if kind == "rotate" else (kind, at))
    documents = spark.createDataFrame([(n, n) for n in range(0, 6)] + [(9, None)], "doc_id long, n_pages int")
    found = pages.edited(documents, edits).collect()
    for n in range(1, 6):
        assert sorted((r.page_no, r.source_page, r.rotation) for r in found if r.doc_id == n) == _plain(n, edits)
    assert not [r for r in found if r.doc_id in (0, 9)]


def test_unknown_edit(spark):
    with pytest.raises(ValueError):
        pages.edited(spark.createDataFrame([(1, 1)], "doc_id long, n_pages int"), [("shuffle", 1)])


def test_errors_of_steps_and_runs(spark):
    rows = [("a", 1, "info", "x", None, None), ("a", 2, "redact", "x", " x ", None), ("a", 3, "info", "x", None, "BROKEN"), ("b", 1, " ", "x", None, None), ("c", 1, "shred", "x", None, None), ("d", 1, "text", " ", None, None), ("e", 1, "redaction.apply", "x", None, None), ("f", 1, "audit", "x", None, "FILE_NOT_FOUND"), ("g", 1, "fill-form", "x", "y", "BAD_VALUE"), ("h", 2, "info", "x", None, "BROKEN"), ("h", 1, "info", "x", None, None), ("i", 1, "render", "x", None, None)]
    judged = batch.checked(spark.createDataFrame(rows, "run string, k int, command string, input string, output string, raised string"), {"BAD_VALUE"})
    found = {r.run: (r.n_steps, r.n_run, r.error_code, r.category, r.exit_code) for r in batch.run_results(judged, "run", "k").collect()}
    assert found == {
        "a": (3, 2, "UNSAFE_OVERWRITE_REFUSED", "SECURITY", 2), "b": (1, 1, "MISSING_COMMAND", "SCHEMA", 2), "c": (1, 1, "UNKNOWN_COMMAND", "SCHEMA", 2), "d": (1, 1, "MISSING_INPUT", "SCHEMA", 2), "e": (1, 1, "MISSING_OUTPUT", "SCHEMA", 2),
        "f": (1, 1, "FILE_NOT_FOUND", "INPUT", 1), "g": (1, 1, "BAD_VALUE", "VALIDATION", 2), "h": (2, 2, "OPERATION_FAILED", "RUNTIME", 1), "i": (1, 1, None, None, 0),
    }


def test_a_gate_leaves_out_what_was_not_measured(spark):
    measures = spark.createDataFrame([("a", 1.0, 0.5), ("b", 3.0, None), ("c", None, None), ("d", 2.0, 0.9)], "g string, ms double, rate double")
    rows = R.gate(measures, ["g"], [("time", "ms", 2.0, "most", "ms"), ("rate", "rate", 0.6, "least", "ratio")]).collect()
    assert {(r.g, r.check): (r.passed, r.gate_passed) for r in rows} == {("a", "time"): (True, False), ("a", "rate"): (False, False), ("b", "time"): (False, False), ("d", "time"): (True, True), ("d", "rate"): (True, True)}


def _turned(line, rtl):
    """The plain rule: each maximal run from a strong letter to the last one before a left-to-right letter is read from its end."""
    col = list(range(len(line)))
    i = 0
    while i < len(line):
        if not rtl(line[i]):
            i += 1
            continue
        end, j = i, i + 1
        while j < len(line) and not (line[j].isalpha() and not rtl(line[j])):
            end, j = (j, j + 1) if rtl(line[j]) else (end, j + 1)
        for k in range(i, end + 1):
            col[k] = i + end - k
        i = end + 1
    return col


@pytest.mark.parametrize("seed", range(3))
def test_right_to_left_runs_against_the_plain_rule(spark, seed):
    rng = random.Random(seed)
    lines = ["".join(rng.choice("אבג ab,.1") for _ in range(rng.randint(0, 25))) for _ in range(40)] + ["אב, גד ab הו. x", "a אב", "אב"]
    rows = [(1, n, c, v, (6.0 * c, 0.0, 6.0 * c + 5, 10.0)) for n, line in enumerate(lines) for c, v in enumerate(line)]
    frame = spark.createDataFrame(rows, "doc_id long, line_no int, col int, value string, box struct<l:double,b:double,r:double,t:double>")
    found = {(r.line_no, r.col): r.logical_col for r in reading.rtl_runs_reversed(frame).collect()}
    rtl = lambda c: bool(re.match(reading.RTL, c))
    for n, line in enumerate(lines):
        assert [found[n, c] for c in range(len(line))] == _turned(line, rtl)


def test_runs_drawn_from_the_right_stay(spark):
    rows = [(1, 0, c, v, (60.0 - 6 * c, 0.0, 65.0 - 6 * c, 10.0)) for c, v in enumerate("אבג")]
    frame = spark.createDataFrame(rows, "doc_id long, line_no int, col int, value string, box struct<l:double,b:double,r:double,t:double>")
    assert reading.rtl_runs_reversed(frame).where(F.col("logical_col") != F.col("col")).count() == 0


def test_moved_letters_of_whole_texts(spark, tmp_path):
    """w9 counts in place what the letter rows give, without a row for each letter."""
    rng = random.Random(7)
    texts = ["".join(rng.choice("אבג ab,.1\ńé²٣𐤀") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["אב\nגד", "\n", "", None, "אבג"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = stream_queries.rtl_runs(spark, f"file://{tmp_path}")
    letters = reading.rtl_runs_reversed(layout.letters(docs))
    plain = letters.groupBy("doc_id").agg(F.count_if(F.col("logical_col") != F.col("col")).alias("moved"), F.count("*").alias("n"))
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(found.select("doc_id", "moved", "n").collect()) == sorted(plain.collect())
