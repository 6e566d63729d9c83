"""Queries on content operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.operators import content
from pagemill.plans.registry import register
from pagemill.plans.search_queries import _LINES
from pagemill.session import table

_OPS = _LINES + """, ops AS (SELECT doc_id, page_no, row * 5 + k AS op_idx, ['BT', 'Tf', 'Td', 'Tj', 'ET'][k + 1] AS name, ['TextObject', 'TextState', 'TextPositioning', 'TextShowing', 'TextObject'][k + 1] AS category,
  CASE WHEN k = 3 THEN text END AS text, CASE WHEN k = 3 THEN 720 - 12 * row END AS b FROM (SELECT *, unnest(range(5)) AS k FROM lines WHERE length(text) > 0))"""


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.layout_operators(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("p2_categories", f"WITH {_OPS} SELECT category, name, count(*) AS n FROM ops GROUP BY 1, 2")
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators by category and name."""
    return _ops(spark, sf_dir).groupBy("category", "name").agg(F.count("*").alias("n"))


@register("p3_without_category", f"WITH {_OPS} SELECT doc_id, page_no, count(*) AS n FROM ops WHERE category <> 'TextShowing' GROUP BY 1, 2")
def without_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.without_category(_ops(spark, sf_dir), "TextShowing").groupBy("doc_id", "page_no").agg(F.count("*").alias("n"))


@register("p8_showing_text", f"WITH {_OPS} SELECT doc_id, page_no, CAST(op_idx AS INTEGER) AS op_idx, text FROM ops WHERE category = 'TextShowing' AND contains(lower(text), 'license')")
def showing_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators that show a needle, whatever its case."""
    return content.showing(_ops(spark, sf_dir), "License", ignore_case=True).select("doc_id", "page_no", "op_idx", "text")


@register("p7_redaction_with_marks", f"""WITH {_OPS}, kept AS (SELECT doc_id, page_no, op_idx, name FROM ops WHERE b IS NULL OR NOT (b < 605 AND b + 10 > 420)),
marks AS (SELECT doc_id, page_no, max(op_idx) + 1 AS nxt FROM ops GROUP BY 1, 2), painted AS (SELECT doc_id, page_no, nxt + k AS op_idx, ['q', 'rg', 're', 'f', 'Q'][k + 1] AS name FROM (SELECT *, unnest(range(5)) AS k FROM marks)),
u AS (SELECT * FROM kept UNION ALL SELECT * FROM painted)
SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY op_idx) - 1 AS INTEGER) AS op_idx, name FROM u""")
def redaction_with_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' operators after a band is redacted and painted over."""
    area = G.rect(F.lit(0), F.lit(420), F.lit(1_000_000), F.lit(605))
    return content.redacted(_ops(spark, sf_dir), area).select("doc_id", "page_no", "op_idx", "name")
