"""File sources: discovery, contract files and their faults, entries under contracts, chunk reports."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pagemill.operators import chunks, quality
from pagemill.sources import contracts, corpus


def _files(tmp_path, names):
    for name in names:
        path = tmp_path / name
        os.makedirs(path.parent, exist_ok=True)
        path.write_bytes(b"x" * len(name))
    return f"file://{tmp_path}"


def test_discovery_in_order_and_chunks(spark, tmp_path):
    folder = _files(tmp_path, ["b.pdf", "a/c.pdf", "a/b/d é.pdf", "A.pdf", "note.txt", "a.pdf/x.pdf", "z/.hidden.txt"])
    found = corpus.discover(spark, folder)
    assert [(r.path, r.position, r.size) for r in found.orderBy("position").collect()] == [(p, i, len(p)) for i, p in enumerate(["A.pdf", "a.pdf/x.pdf", "a/b/d é.pdf", "a/c.pdf", "b.pdf"])]
    include = spark.createDataFrame([(" a\\c.pdf ",), ("b.pdf",), ("missing.pdf",)], "path string")
    assert [r.path for r in corpus.discover(spark, folder, include=include).orderBy("position").collect()] == ["a/c.pdf", "b.pdf"]
    parts = [[r.path for r in corpus.chunk(found, k, 2).collect()] for k in range(2)]
    assert sorted(parts[0] + parts[1]) == sorted(r.path for r in found.collect()) and len(parts[0]) == 3
    with pytest.raises(ValueError):
        corpus.chunk(found, 2, 2)


def test_discovery_of_nothing(spark, tmp_path):
    assert corpus.discover(spark, _files(tmp_path, ["a.txt"])).count() == 0


def _contract(tmp_path, name, body):
    path = tmp_path / name
    os.makedirs(path.parent, exist_ok=True)
    path.write_text(json.dumps(body, indent=1))
    return f"file://{tmp_path}"


def test_contract_pages_and_precedence(spark, tmp_path):
    _contract(tmp_path, "_draft.json", {"Path": "no.pdf", "Pages": {"x": {}}})
    _contract(tmp_path, "a/one.json", {"Path": " a\\x.pdf ", "ReviewStatus": "REVIEWED", "Confidence": "LOW", "Issue": 5, "Target": {"Mode": "PDF_SPEC", "Primary": "r1"}, "Pages": {" 2-3 ": {"QualityStatus": "GOOD_ENOUGH", "Confidence": "HIGH", "Target": {"Primary": "r2"}}, "7": {"Confidence": " ", "Issue": 9}}})
    folder = _contract(tmp_path, "b.json", {"Path": "y.pdf", "Pages": {"1": {}}})
    found = {(r.path, r.page_no): r for r in contracts.load_contracts(spark, folder).collect()}
    assert set(found) == {("a/x.pdf", 2), ("a/x.pdf", 3), ("a/x.pdf", 7), ("y.pdf", 1)}
    assert [(found["a/x.pdf", n].confidence, found["a/x.pdf", n].target_renderer, found["a/x.pdf", n].target_mode, found["a/x.pdf", n].issue, found["a/x.pdf", n].review_status) for n in (3, 7)] == [("HIGH", "r2", None, 5, "REVIEWED"), ("LOW", "r1", "PDF_SPEC", 9, "REVIEWED")]
    assert found["a/x.pdf", 2].quality_status == "GOOD_ENOUGH" and not found["y.pdf", 1].has_target


FAULTS = [
    ({"Pages": {"1": {}}}, "no path"),
    ({"Path": "a", "Pages": {}}, "no pages"),
    ({"Path": "a", "Pages": {"3-2": {}}}, "page key 3-2"),
    ({"Path": "a", "Pages": {"x": {}}}, "page key x"),
    ({"Path": "a", "Pages": {"-1": {}}}, "page key -1"),
    ({"Path": "a", "ReviewStatus": "MAYBE", "Pages": {"1": {}}}, "review_status MAYBE"),
    ({"Path": "a", "Pages": {"1": {"ReleaseStatus": "pass"}}}, "release_status pass"),
    ({"Path": "a", "Pages": {"1": {"Target": {"Mode": "GUESS"}}}}, "target_mode GUESS"),
    ({"Path": "a", "Pages": {"1": {"ExpectedRawStatus": "PASS", "PixelAgreement": "MATCHES_NONE"}}}, "pixel_agreement against raw_status"),
    ({"Path": "a", "Pages": {"1": {"QualityStatus": "FAIL", "ReleaseStatus": "PASS"}}}, "quality FAIL with release PASS"),
    ({"Path": "a", "Pages": {"1": {"QualityStatus": "GOOD_ENOUGH", "PixelAgreement": "NOT_COMPARABLE"}}}, "pixel_agreement against quality_status"),
    ({"Path": "a", "Pages": {"1-3": {}, "2": {}}}, "named twice"),
]


def test_faults(spark, tmp_path):
    for i, (body, _) in enumerate(FAULTS):
        folder = _contract(tmp_path, f"c{i}.json", body | ({"Path": f"a{i}"} if "Path" in body else {}))
    found = {}
    for r in contracts.problems(contracts.read_contract_pages(spark, folder)).collect():
        found.setdefault(int(r.file.rpartition("/c")[2].removesuffix(".json")), set()).add(r.problem)
    assert found == {i: {problem} for i, (_, problem) in enumerate(FAULTS)}
    with pytest.raises(ValueError, match="no path"):
        contracts.load_contracts(spark, folder)


ENTRY = "path string, page_no int, status string, result string, result_category string, result_reason string, expected_note string, compared int, agreeing int, pairs int, disagreeing int, rank int, best string"


def _judged(spark, tmp_path, cases, strict=False):
    """Each case (page or None, document, status, numbers) as an entry of its own path, under one set of contracts."""
    rows = []
    for i, (page, shared, status, extra) in enumerate(cases):
        folder = _contract(tmp_path, f"c{i}.json", {"Path": f"p{i}", **(shared or {}), "Pages": {"1": page}} if page is not None else {"Path": f"other{i}", "Pages": {"1": {}}})
        n = {"compared": 3, "agreeing": 2, "pairs": 3, "disagreeing": 1, "rank": 1} | extra
        rows.append((f"p{i}", 1, status, "PASS", None, None, "note", n["compared"], n["agreeing"], n["pairs"], n["disagreeing"], n["rank"], "r1"))
    found = quality.with_contracts(spark.createDataFrame(rows, ENTRY), contracts.load_contracts(spark, folder), strict)
    return [r for _, r in sorted((int(r.path[1:]), r) for r in found.collect())]


OVERRULED = [({"PixelAgreement": "MATCHES_SOME"}, "PASS", "MATCHES_ALL_REQUIRED"), ({"PixelAgreement": "MATCHES_SOME"}, "DIFF", "MATCHES_NONE"), ({"PixelAgreement": "NOT_COMPARABLE"}, "DIFF", "NOT_COMPARABLE"), ({"PixelAgreement": "MATCHES_NONE"}, "PASS_ONE", "MATCHES_SOME"), ({}, "TIMEOUT", "NOT_COMPARABLE")]


def test_raw_status_overrules_a_contract(spark, tmp_path):
    found = _judged(spark, tmp_path, [(page, None, status, {}) for page, status, _ in OVERRULED])
    assert [r.pixel_agreement for r in found] == [expected for _, _, expected in OVERRULED]


TOLD = {"Target": {"Mode": "PDF_SPEC", "Primary": "r1"}, "QualityReason": "looked at"}
REVIEWS = [
    ({}, TOLD, {}, "accepted", "PASS"),
    ({"ReleaseStatus": "BLOCKED"}, TOLD, {}, "rejected", "BLOCKED"),
    ({"QualityStatus": "FAIL"}, TOLD, {}, "rejected", "PASS"),
    (None, None, {}, "unreviewed", "NEEDS_REVIEW"),
    ({"ReviewStatus": "REVIEWED"}, {"ReviewStatus": "GENERATED"}, {}, "accepted", "PASS"),
    ({}, {**TOLD, "ReviewStatus": "GENERATED"}, {}, "unreviewed", "NEEDS_REVIEW"),
    ({}, {**TOLD, "RootCause": "FULL_CORPUS_BASELINE"}, {}, "unreviewed", "NEEDS_REVIEW"),
    ({"Notes": "Auto-Classified"}, TOLD, {}, "unreviewed", "NEEDS_REVIEW"),
    ({}, {"QualityReason": "no target"}, {}, "unreviewed", "NEEDS_REVIEW"),
    ({}, {"Target": {"Mode": "PDF_SPEC"}}, {}, "unreviewed", "NEEDS_REVIEW"),
    ({}, TOLD, {"agreeing": 1, "disagreeing": 0}, "unreviewed", "NEEDS_REVIEW"),
    ({}, TOLD, {"agreeing": 1, "rank": 3}, "unreviewed", "NEEDS_REVIEW"),
    ({}, TOLD, {"agreeing": 1, "rank": 3, "compared": 2}, "accepted", "PASS"),
]


def test_pages_that_match_one_renderer(spark, tmp_path):
    found = _judged(spark, tmp_path, [(page, shared, "PASS_ONE", extra) for page, shared, extra, _, _ in REVIEWS])
    assert [(r.pass_one_review, r.release_status) for r in found] == [case[3:] for case in REVIEWS]
    assert [r.quality_status == "NEEDS_REVIEW" for r in found] == [case[3] == "unreviewed" for case in REVIEWS]


def test_strict_and_summary(spark, tmp_path):
    (found,) = _judged(spark, tmp_path, [(None, None, "PASS", {})], strict=True)
    assert (found.release_status, found.quality_status, found.contract_status, found.quality_reason) == ("NEEDS_REVIEW", "NEEDS_REVIEW", "MISSING", "No contract covers this page.")
    frame = spark.createDataFrame([found.asDict()], "path string, status string, release_status string, quality_status string, pixel_agreement string, reference_situation string, target_basis string, root_cause string, priority string, confidence string, pass_one_review string, contract_status string")
    counts = {(r.field, r.value): r.n for r in quality.summary(frame).collect()}
    assert counts["release_status", "NEEDS_REVIEW"] == 1 and len(counts) == len(quality.SUMMARISED)


def test_chunk_reports(spark):
    one = spark.createDataFrame([("a", 1, "PASS", 5)], "path string, pageNumber int, status string, elapsedMs long")
    two = spark.createDataFrame([("b", 1, "MALFORMED_PDF", "x" * 150)], "Path string, PageNumber int, Status string, ErrorMessage string")
    names = ["path", "pageNumber", "status", "elapsedMs", "errorPhase", "errorType", "errorMessage", "diagnostic"]
    entries = chunks.one_form(one, names).unionByName(chunks.one_form(two, names))
    attempts = spark.createDataFrame([("a", 1, 0), ("b", 1, 0), ("c", 1, 124), ("d", 1, 1), ("e", 2, 0), ("a", 2, 137)], "path string, pageNumber int, code int")
    merged = chunks.with_crashed(entries, attempts)
    assert sorted((r.path, r.pageNumber, r.status) for r in merged.collect()) == [("a", 1, "PASS"), ("a", 2, "SCANNER_CRASH"), ("b", 1, "MALFORMED_PDF"), ("c", 1, "TIMEOUT"), ("d", 1, "SCANNER_CRASH"), ("e", 2, "SCANNER_CRASH")]
    listed = chunks.failures(merged, n=3).collect()
    assert [(r.path, r.kind) for r in listed] == [("a", "ProcessExit"), ("b", "-"), ("c", "ProcessTimeout")] and listed[1].message == "x" * 137 + "..."
    assert [r.path for r in chunks.slowest(merged).collect()] == ["a"]
