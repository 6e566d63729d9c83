"""Queries on contract, password and report files that are derived from the tables, written to the shared folder and read from there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import chunks, quality
from pagemill.operators import reports as R
from pagemill.plans.registry import register
from pagemill.plans.report_queries import _SCAN, scan
from pagemill.session import table
from pagemill.sources import contracts, manifests
from pagemill.storage import shared_folder


def _written(rows: DataFrame, kind: str) -> str:
    """A new folder of JSON lines or of text with the rows."""
    folder = f"{shared_folder(rows.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    (rows.write.json if kind == "contracts" or kind == "report" else rows.write.text)(folder)
    return folder


_LABELLED = "c AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels WHERE doc_id IS NOT NULL GROUP BY 1)"


def _contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reviewers would have agreed for the labelled documents, as contract files."""
    labelled = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    rows = scan(spark, sf_dir).select("doc_id", "path").join(labelled, "doc_id")
    i, no = F.col("doc_id"), F.lit(None).cast("string")
    page = F.struct(F.when(F.col("t") == 1, "BLOCKED").alias("ReleaseStatus"), F.when((F.col("q") == 1) & (i % 7 == 0), "ACCEPTED_LIMITATION").alias("QualityStatus"), F.when(i % 3 == 0, "MATCHES_SOME").otherwise(" ").alias("PixelAgreement"), F.when(i % 6 == 1, "P0").alias("ImprovementPriority"))
    target = F.when(i % 4 != 3, F.struct(F.lit("REFERENCE_RENDERER").alias("Mode"), F.lit("r1").alias("Primary"), no.alias("Reason")))
    review = F.when(i % 5 == 0, "REVIEWED").when(i % 5 == 1, "GENERATED")
    file = rows.select(F.concat(F.lit(" "), "path").alias("Path"), review.alias("ReviewStatus"), F.lit("P1").alias("ImprovementPriority"), F.when(F.col("q") == 1, "known").alias("QualityReason"), target.alias("Target"), F.map_from_arrays(F.array(F.when(i % 2 == 0, "1").otherwise("1-2")), F.array(page)).alias("Pages"))
    return contracts.load_contracts(spark, _written(file, "contracts"), one_per_file=False)


@register("s11_contract_pages", f"""WITH {_SCAN}, {_LABELLED}, x AS (SELECT s.path, s.doc_id, q, t, unnest(CASE WHEN s.doc_id % 2 = 0 THEN [1] ELSE [1, 2] END) AS page_no FROM scan s JOIN c USING (doc_id))
SELECT path, CAST(page_no AS INTEGER) AS page_no, CASE WHEN t = 1 THEN 'BLOCKED' END AS release_status, CASE WHEN doc_id % 3 = 0 THEN 'MATCHES_SOME' END AS pixel_agreement, CASE WHEN doc_id % 6 = 1 THEN 'P0' ELSE 'P1' END AS priority, CASE doc_id % 5 WHEN 0 THEN 'REVIEWED' WHEN 1 THEN 'GENERATED' END AS review_status, CASE WHEN doc_id % 4 <> 3 THEN 'r1' END AS target_renderer FROM x""")
def contract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of the contract files with what its page or its document says."""
    return _contracts(spark, sf_dir).select("path", "page_no", "release_status", "pixel_agreement", "priority", "review_status", "target_renderer")


_JUDGED = f"""WITH {_SCAN}, {_LABELLED}, j AS (SELECT s.*, c.doc_id IS NOT NULL AS known, q, t, compared - disagreeing AS agreeing, s.doc_id % 4 AS rank, CASE WHEN s.doc_id % 2 = 0 THEN 'r1' ELSE 'r2' END AS best, CASE WHEN c.doc_id IS NOT NULL AND s.doc_id % 4 <> 3 THEN 'r1' END AS target FROM scan s LEFT JOIN c USING (doc_id)),
a AS (SELECT *, CASE status WHEN 'PASS' THEN 'MATCHES_ALL_REQUIRED' WHEN 'PASS_ONE' THEN CASE WHEN best = target THEN 'MATCHES_TARGET' WHEN agreeing = 1 THEN 'MATCHES_ONE_REFERENCE' ELSE 'MATCHES_SOME' END WHEN 'DIFF' THEN 'MATCHES_NONE' ELSE 'NOT_COMPARABLE' END AS inferred,
  CASE WHEN known AND q = 1 AND doc_id % 7 = 0 THEN 'ACCEPTED_LIMITATION' ELSE CASE status WHEN 'PASS' THEN 'PIXEL_EXACT' WHEN 'PASS_ONE' THEN 'MATCHES_ACCEPTED_REFERENCE' WHEN 'MALFORMED_PDF' THEN 'NON_RENDERABLE_ACCEPTED' WHEN 'DIFF' THEN 'FAIL' ELSE CASE WHEN result = 'PASS' THEN 'GOOD_ENOUGH' ELSE 'FAIL' END END END AS q0,
  CASE WHEN known AND t = 1 THEN 'BLOCKED' ELSE 'PASS' END AS r0, compared >= 3 AND ((agreeing = 1 AND disagreeing = 0) OR (agreeing <= 1 AND rank >= 3)) AS odd FROM j),
b AS (SELECT *, CASE WHEN known AND doc_id % 3 = 0 THEN 'MATCHES_SOME' ELSE inferred END AS proposed, CASE WHEN status <> 'PASS_ONE' THEN 'N/A' WHEN r0 = 'BLOCKED' OR q0 = 'FAIL' THEN 'rejected' WHEN NOT known THEN 'unreviewed' WHEN doc_id % 5 = 0 THEN 'accepted' WHEN doc_id % 5 = 1 OR odd OR doc_id % 4 = 3 OR q IS DISTINCT FROM 1 THEN 'unreviewed' ELSE 'accepted' END AS review FROM a),
judged AS (SELECT path, status, CASE WHEN known THEN 'APPLIED' ELSE 'MISSING' END AS contract_status, review AS pass_one_review, CASE WHEN review = 'unreviewed' THEN 'NEEDS_REVIEW' ELSE r0 END AS release_status, CASE WHEN review = 'unreviewed' THEN 'NEEDS_REVIEW' ELSE q0 END AS quality_status,
  CASE WHEN status = 'PASS' THEN 'MATCHES_ALL_REQUIRED' WHEN status = 'DIFF' AND proposed NOT IN ('MATCHES_NONE', 'NOT_COMPARABLE') THEN 'MATCHES_NONE' ELSE proposed END AS pixel_agreement, CASE WHEN known THEN CASE WHEN doc_id % 6 = 1 THEN 'P0' ELSE 'P1' END WHEN status = 'DIFF' THEN 'P1' WHEN status = 'PASS_ONE' THEN 'P2' ELSE 'NONE' END AS priority FROM b)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan report under the contract files."""
    i, no = F.col("doc_id"), F.lit(None).cast("string")
    entries = scan(spark, sf_dir).select("path", F.lit(1).alias("page_no"), "status", "result", no.alias("result_category"), no.alias("result_reason"), no.alias("expected_note"), "compared", (F.col("compared") - F.col("disagreeing")).alias("agreeing"), F.col("compared").alias("pairs"), "disagreeing", (i % 4).alias("rank"), F.when(i % 2 == 0, "r1").otherwise("r2").alias("best"))
    return quality.with_contracts(entries, _contracts(spark, sf_dir))


@register("c21_contracts", _JUDGED + " SELECT path, contract_status, pass_one_review, release_status, quality_status, pixel_agreement, priority FROM judged")
def under_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is released, how good it is and what waits for review, of each page of a scan under contract files."""
    return _judged(spark, sf_dir).select("path", "contract_status", "pass_one_review", "release_status", "quality_status", "pixel_agreement", "priority")


@register("c21_summary", _JUDGED + " SELECT field, value, count(*) AS n FROM (UNPIVOT (SELECT status, release_status, quality_status, pixel_agreement, priority, pass_one_review, contract_status FROM judged) ON COLUMNS(*) INTO NAME field VALUE value) GROUP BY 1, 2")
def judged_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by each field of a scan under contracts."""
    return quality.summary(_judged(spark, sf_dir)).where(~F.col("field").isin("reference_situation", "target_basis", "root_cause", "confidence"))


@register("j3_passwords", f"""WITH {_SCAN}, pw AS (SELECT path, 'pw' || doc_id AS password FROM scan WHERE doc_id % 4 = 0 UNION ALL SELECT CASE WHEN doc_id % 3 = 0 THEN 'pdfjs/f' || doc_id ELSE 'f' || doc_id END, 'file' || doc_id FROM scan WHERE doc_id % 5 = 0)
SELECT s.path, coalesce(a.password, b.password, c.password) AS password FROM scan s LEFT JOIN pw a ON a.path = s.path LEFT JOIN pw b ON NOT contains(s.path, '/') AND b.path = 'pdfjs/' || s.path LEFT JOIN pw c ON starts_with(s.path, 'pdfjs/') AND c.path = substr(s.path, 7)""")
def passwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The password of each file from a manifest of tab-separated lines: by its path, else with the first folder added or taken away."""
    rows = scan(spark, sf_dir)
    i = F.col("doc_id")
    line = lambda path, word: F.concat_ws("\t", path, F.concat(F.lit(word), i.cast("string"))).alias("value")
    lines = rows.where(i % 4 == 0).select(line(F.col("path"), "pw")).unionByName(rows.where(i % 5 == 0).select(line(F.concat(F.when(i % 3 == 0, "pdfjs/f").otherwise("f"), i.cast("string")), "file")))
    return R.looked_up(rows.select("path"), manifests.read_passwords(spark, _written(lines, "passwords")), "password", "pdfjs/")


_CHUNKED = f"""WITH {_SCAN}, u AS (SELECT path, CASE WHEN n_chars % 7 = 0 THEN 'TIMEOUT' WHEN n_chars % 11 = 0 THEN 'SCANNER_CRASH' ELSE status END AS status, CASE WHEN n_chars % 7 = 0 OR n_chars % 11 = 0 THEN NULL ELSE CAST(elapsed_ms AS BIGINT) END AS ms,
  CASE WHEN n_chars % 7 = 0 THEN 'ProcessTimeout' WHEN n_chars % 11 = 0 THEN 'ProcessExit' ELSE '-' END AS kind, CASE WHEN n_chars % 7 = 0 THEN 'scan exited 124 before writing a single-page report' WHEN n_chars % 11 = 0 THEN 'scan exited 139 before writing a single-page report' ELSE '' END AS message FROM scan)"""


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of two chunks, one with capitals in its names, as files; and the return code of each attempt, whose page is not in a report where it is not 0."""
    rows = scan(spark, sf_dir).withColumn("code", F.when(F.col("n_chars") % 7 == 0, 124).when(F.col("n_chars") % 11 == 0, 139).otherwise(0))
    names = ["path", "pageNumber", "status", "elapsedMs", "errorPhase", "errorType", "errorMessage", "diagnostic"]
    none = [F.lit(None).cast("string").alias(n) for n in names[4:]]
    even = rows.where("code = 0 and doc_id % 2 = 0").select("path", F.lit(1).alias("pageNumber"), "status", F.col("elapsed_ms").cast("long").alias("elapsedMs"), *none)
    odd = rows.where("code = 0 and doc_id % 2 = 1").select(F.col("path").alias("Path"), F.lit(1).alias("PageNumber"), F.col("status").alias("Status"), F.col("elapsed_ms").cast("long").alias("ElapsedMs"))
    merged = None
    for part in (even, odd):
        read = chunks.one_form(spark.read.schema(part.schema).json(_written(part, "report")), names)
        merged = read if merged is None else merged.unionByName(read)
    return chunks.with_crashed(merged, rows.select("path", F.lit(1).alias("pageNumber"), "code"))


@register("k18_merged_reports", _CHUNKED + " SELECT status, count(*) AS n, max(ms) AS slowest FROM u GROUP BY 1")
def merged_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of chunks, whose names differ in their capitals, as one, with a row for each page whose scan did not end well."""
    return _chunked(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.max("elapsedMs").alias("slowest"))


@register("k18_slowest_pages", _CHUNKED + " SELECT path, ms AS elapsedMs FROM u WHERE ms > 0 ORDER BY ms DESC, path LIMIT 10")
def slowest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten slowest pages (a top-k report)."""
    return chunks.slowest(_chunked(spark, sf_dir)).select("path", "elapsedMs")


@register("k19_crashed_pages", _CHUNKED + " SELECT path, status, kind, message FROM u WHERE status IN ('TIMEOUT', 'SCANNER_CRASH', 'MALFORMED_PDF') ORDER BY path LIMIT 20")
def crashed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty pages of the failure list (a top-k report)."""
    return chunks.failures(_chunked(spark, sf_dir)).select("path", "status", "kind", "message")
