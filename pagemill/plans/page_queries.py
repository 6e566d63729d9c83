"""Queries on pages: splitting, merging, numbering, labels, batch steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import batch, pages, reports
from pagemill.operators.ranges import running
from pagemill.plans.registry import register
from pagemill.session import table
from pagemill.sources import layout

_PAGES = """doc_pages AS (SELECT doc_id, source, lang, CAST(ceil(len(string_split(text, chr(10))) / 60.0) AS INTEGER) AS n_pages FROM documents),
page_rows AS (SELECT doc_id, source, lang, n_pages, CAST(unnest(range(1, n_pages + 1)) AS INTEGER) AS page_no FROM doc_pages)"""


def _doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", F.ceil(F.size(F.split("text", "\n", -1)) / layout.LINES_PER_PAGE).cast("int").alias("n_pages"))


def _page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_pages(spark, sf_dir).withColumn("page_no", F.explode(F.sequence(F.lit(1), F.col("n_pages"))))


@register("w3_running_numbers", f"""WITH {_PAGES} SELECT source, doc_id, n_pages, CAST(coalesce(sum(n_pages) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS first_number FROM doc_pages""")
def running_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running page number at which each document of a set begins."""
    return pages.first_numbers(_doc_pages(spark, sf_dir).select("source", "doc_id", "n_pages"), "source")


@register("c19_numbered_set", f"""WITH {_PAGES}, f AS (SELECT source, doc_id, n_pages, coalesce(sum(n_pages) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS first FROM doc_pages),
x AS (SELECT source, doc_id, unnest(range(1, n_pages + 1)) AS page_no, first FROM f)
SELECT source, doc_id, CAST(page_no AS INTEGER) AS page_no, 'DOC-' || CASE WHEN first + page_no - 1 >= 1000 THEN CAST(CAST(first + page_no - 1 AS BIGINT) AS VARCHAR) ELSE lpad(CAST(CAST(first + page_no - 1 AS BIGINT) AS VARCHAR), 3, '0') END || '-R' AS label FROM x""")
def numbered_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's running label; short numbers are padded, long ones are never cut."""
    return pages.numbered_pages(_doc_pages(spark, sf_dir), "source", "DOC-", 3, "-R")


@register("w6_split_every", f"WITH {_PAGES} SELECT doc_id, page_no, CAST(floor((page_no - 1) / 2) AS INTEGER) AS part, CAST((page_no - 1) % 2 + 1 AS INTEGER) AS part_page FROM page_rows")
def split_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of two pages."""
    return pages.split_every(_page_rows(spark, sf_dir).select("doc_id", "page_no"), 2)


@register("w7_split_at", f"""WITH {_PAGES} SELECT doc_id, page_no, CAST(sum(CASE WHEN page_no = 1 OR page_no % 3 = (doc_id % 3) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_no) - 1 AS INTEGER) AS part FROM page_rows""")
def split_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that begin at given pages."""
    rows = _page_rows(spark, sf_dir).select("doc_id", "page_no")
    return pages.split_at(rows, rows.where(F.col("page_no") % 3 == F.col("doc_id") % 3))


@register("w8_chunks", "SELECT doc_id, CAST(rn % 8 AS INTEGER) AS chunk, CAST(rn AS BIGINT) AS position FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rn FROM documents)")
def corpus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source dealt in order over eight chunks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    position = F.col("nth") - 1
    return running(docs, ["source"], ["doc_id"]).select("doc_id", (position % 8).cast("int").alias("chunk"), position.alias("position"))


@register("o8_merge", f"WITH {_PAGES} SELECT lang, doc_id, page_no, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY doc_id, page_no) AS INTEGER) AS merged_page FROM page_rows")
def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a language and source as one: every page's number in it."""
    rows = _page_rows(spark, sf_dir).withColumn("set", F.concat_ws("/", "lang", "source"))
    return pages.merged(rows, ["doc_id", "page_no"], "set").select("lang", "doc_id", "page_no", "merged_page")


@register("o8_unique_names", """SELECT doc_id, source, lang, CASE WHEN n = 1 THEN lang ELSE lang || ' (' || n || ')' END AS unique_name FROM (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents)""")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made unique within each source."""
    return pages.unique_names(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "source", "lang", ["doc_id"])


@register("o12_move_page", f"""WITH {_PAGES} SELECT doc_id, page_no, CAST(CASE WHEN n_pages < 3 THEN page_no WHEN page_no = 3 THEN 1 WHEN page_no < 3 THEN page_no + 1 ELSE page_no END AS INTEGER) AS new_page_no FROM page_rows""")
def move_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page numbers after page 3 moves to the front."""
    return pages.moved(_page_rows(spark, sf_dir).select("doc_id", "page_no"), 3, 1)


@register("o12_page_edits", f"""WITH {_PAGES}, a AS (SELECT doc_id, CASE WHEN n_pages > 1 THEN list_concat([1], range(3, n_pages + 1)) ELSE range(1, n_pages + 1) END AS p FROM doc_pages WHERE n_pages > 0), b AS (SELECT doc_id, list_concat([NULL], p) AS p FROM a),
x AS (SELECT doc_id, unnest(CASE WHEN len(p) >= 3 THEN list_concat(p[2:3], p[1:1], p[4:]) ELSE p END) AS source_page, unnest(range(1, len(p) + 1)) AS page_no FROM b)
SELECT doc_id, CAST(page_no AS INTEGER) AS page_no, CAST(source_page AS INTEGER) AS source_page, CASE WHEN page_no = 2 THEN 270 ELSE 0 END AS rotation FROM x""")
def page_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pages after page 2 is removed, a blank page put first and moved to place 3, and page 2 turned."""
    return pages.edited(_doc_pages(spark, sf_dir), [("remove", 2), ("insert", 1), ("move", 1, 3), ("rotate", 2, 90), ("rotate", 2, -180)])


@register("j13_page_labels", f"""WITH {_PAGES}, x AS (SELECT doc_id, page_no, CASE WHEN page_no < 3 THEN 1 ELSE 3 END AS start FROM page_rows)
SELECT doc_id, page_no, CASE WHEN start = 1 THEN CASE page_no WHEN 1 THEN 'I' ELSE 'II' END ELSE CAST(page_no - start + 1 AS VARCHAR) END AS label FROM x""")
def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page labels: roman for the first two pages, then decimal from 1."""
    rows = _page_rows(spark, sf_dir).select("doc_id", "page_no")
    runs = rows.where("page_no in (1, 3)").select("doc_id", "page_no", F.when(F.col("page_no") == 1, "roman").otherwise("decimal").alias("style"), F.lit(1).alias("first"))
    return pages.page_labels(rows, runs).select("doc_id", "page_no", "label")


@register("p18_page_selection", f"WITH {_PAGES} SELECT doc_id, page_no FROM page_rows WHERE page_no IN (1, 2, 5, 20)")
def page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample pages of every document."""
    return pages.page_selection(_page_rows(spark, sf_dir).select("doc_id", "page_no"), "Sample")


@register("f12_labels", f"""WITH {_PAGES}, n AS (SELECT DISTINCT CAST((doc_id % 60) + 1 AS INTEGER) AS n FROM documents)
SELECT n, repeat('L', CAST(floor(n / 50) AS INTEGER)) || CASE WHEN n % 50 >= 40 THEN 'XL' ELSE repeat('X', CAST(floor((n % 50) / 10) AS INTEGER)) END || CASE n % 10 WHEN 9 THEN 'IX' WHEN 4 THEN 'IV' ELSE repeat('V', CAST(floor((n % 10) / 5) AS INTEGER)) || repeat('I', CAST((n % 10) % 5 AS INTEGER)) END AS roman,
  CASE WHEN n > 26 THEN chr(CAST(64 + (n - 1) // 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (n - 1) % 26 AS INTEGER)) AS letters FROM n""")
def label_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roman and alphabetic labels of the numbers that ids give."""
    n = table(spark, sf_dir, "documents").select(((F.col("doc_id") % 60) + 1).cast("int").alias("n")).distinct()
    return n.select("n", T.roman(F.col("n")).alias("roman"), T.alphabetic(F.col("n")).alias("letters"))


_JOBS = """jobs AS (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'info' WHEN 1 THEN ' text ' WHEN 2 THEN 'redact' WHEN 3 THEN 'audit-hidden-text' WHEN 4 THEN 'shred' END AS command, CASE WHEN length(text) % 5 = 0 THEN ' ' ELSE role || '.pdf' END AS input, CASE WHEN length(text) % 7 = 0 THEN role || '.pdf' WHEN length(text) % 11 = 0 THEN NULL ELSE 'out.pdf' END AS output,
  CASE WHEN length(text) % 13 = 0 THEN 'EMPTY_FIELD' WHEN length(text) % 17 = 0 THEN 'FILE_NOT_FOUND' WHEN length(text) % 19 = 0 THEN 'BROKEN' END AS raised FROM conversations WHERE text IS NOT NULL)"""


@register("c20_workflow", f"""WITH {_JOBS}, n AS (SELECT *, CASE trim(command) WHEN 'info' THEN 'document.info' WHEN 'text' THEN 'text.extract' WHEN 'redact' THEN 'redaction.apply' WHEN 'audit-hidden-text' THEN 'audit.hidden-text' ELSE trim(command) END AS name FROM jobs),
e AS (SELECT *, CASE WHEN coalesce(name, '') = '' THEN 'MISSING_COMMAND' WHEN name = 'shred' THEN 'UNKNOWN_COMMAND' WHEN trim(input) = '' THEN 'MISSING_INPUT' WHEN name = 'redaction.apply' AND coalesce(trim(output), '') = '' THEN 'MISSING_OUTPUT' WHEN name = 'redaction.apply' AND output = input THEN 'UNSAFE_OVERWRITE_REFUSED' ELSE CASE WHEN raised = 'BROKEN' THEN 'OPERATION_FAILED' ELSE raised END END AS code FROM n),
c AS (SELECT *, CASE WHEN code IS NULL THEN NULL WHEN code = 'UNSAFE_OVERWRITE_REFUSED' THEN 'SECURITY' WHEN code LIKE 'MISSING%' OR code = 'UNKNOWN_COMMAND' THEN 'SCHEMA' WHEN code = 'EMPTY_FIELD' THEN 'VALIDATION' WHEN code = 'FILE_NOT_FOUND' THEN 'INPUT' ELSE 'RUNTIME' END AS category FROM e),
r AS (SELECT *, coalesce(sum(CASE WHEN code IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS ran FROM c)
SELECT conv_id, count(*) AS n_steps, count(*) FILTER (WHERE ran) AS n_run, any_value(code) FILTER (WHERE ran AND code IS NOT NULL) AS error_code, any_value(category) FILTER (WHERE ran AND code IS NOT NULL) AS category,
  CASE any_value(category) FILTER (WHERE ran AND code IS NOT NULL) WHEN 'INPUT' THEN 1 WHEN 'RUNTIME' THEN 1 WHEN 'SCHEMA' THEN 2 WHEN 'SECURITY' THEN 2 WHEN 'VALIDATION' THEN 2 ELSE 0 END AS exit_code FROM r GROUP BY 1""")
def workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of steps up to its first error: what the error was, of which category, and the run's exit code."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    n, k = F.length("text"), F.col("turn") % 6
    command = F.when(k == 0, "info").when(k == 1, " text ").when(k == 2, "redact").when(k == 3, "audit-hidden-text").when(k == 4, "shred")
    file = F.concat("role", F.lit(".pdf"))
    steps = turns.select("conv_id", "turn", command.alias("command"), F.when(n % 5 == 0, " ").otherwise(file).alias("input"), F.when(n % 7 == 0, file).when(n % 11 == 0, None).otherwise("out.pdf").alias("output"), F.when(n % 13 == 0, "EMPTY_FIELD").when(n % 17 == 0, "FILE_NOT_FOUND").when(n % 19 == 0, "BROKEN").alias("raised"))
    return batch.run_results(batch.checked(steps, {"EMPTY_FIELD"}), "conv_id", "turn")


_STEPS = "steps AS (SELECT conv_id, turn, role, length(text) AS n, CASE WHEN length(text) > 900 THEN 'FAIL' ELSE 'PASS' END AS status FROM conversations WHERE text IS NOT NULL)"


@register("o7_stop_on_error", f"""WITH {_STEPS} SELECT conv_id, turn, status FROM (SELECT *, coalesce(sum(CASE WHEN status = 'FAIL' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM steps) WHERE f = 0""")
def stop_on_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps up to and including the first failure of each run."""
    return reports.until_first_failure(batch.steps_of(table(spark, sf_dir, "conversations")), "conv_id", "turn", F.col("status") == "FAIL").select("conv_id", "turn", "status")


@register("a25_batch_report", f"""WITH {_STEPS}, r AS (SELECT *, coalesce(sum(CASE WHEN status = 'FAIL' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM steps)
SELECT conv_id, count(*) AS n_steps, count(*) FILTER (WHERE f = 0) AS n_run, count(*) FILTER (WHERE f = 0 AND status = 'PASS') AS n_passed, CASE WHEN count(*) FILTER (WHERE f = 0 AND status = 'PASS') = count(*) THEN 'PASS' ELSE 'FAIL' END AS status FROM r GROUP BY conv_id""")
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's steps, how many ran and passed, and its verdict."""
    return batch.report(batch.steps_of(table(spark, sf_dir, "conversations")), "conv_id", "turn")


@register("c20_batch_errors", f"""WITH {_STEPS} SELECT role, status, CASE WHEN status = 'FAIL' AND n > 1500 THEN 'INPUT' WHEN status = 'FAIL' THEN 'VALIDATION' ELSE 'NONE' END AS category, count(*) AS n FROM steps GROUP BY 1, 2, 3""")
def batch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps by role, status and error category."""
    steps = batch.steps_of(table(spark, sf_dir, "conversations"))
    category = F.when((F.col("status") == "FAIL") & (F.col("n") > 1500), "INPUT").when(F.col("status") == "FAIL", "VALIDATION").otherwise("NONE")
    return steps.groupBy("role", "status", category.alias("category")).agg(F.count("*").alias("n"))
