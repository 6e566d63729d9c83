"""Queries on extraction confidence, hidden text and differing extractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.functions import text as T
from pagemill.operators import audit
from pagemill.operators.words import line_words
from pagemill.plans.registry import register
from pagemill.session import spread, table
from pagemill.sources import layout

#: Extracted text of a document: every third line is lost and x stands for e in documents whose id divides by 5; no expectation where it divides by 7.
_EXTRACTED = """ext AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS expected,
  CASE WHEN doc_id % 5 = 0 THEN replace(text, 'e', '') WHEN doc_id % 5 = 1 THEN substr(text, 1, CAST(floor(length(text) / 3) AS INTEGER)) ELSE text END AS extracted FROM documents WHERE text IS NOT NULL)"""
_KEYS = _EXTRACTED + """, keyed AS (SELECT *, length(regexp_replace(extracted, '[^\\p{L}\\p{Nd}]', '', 'g')) AS cx, length(regexp_replace(expected, '[^\\p{L}\\p{Nd}]', '', 'g')) AS ce,
  lower(regexp_replace(extracted, '[^A-Za-z0-9]', '', 'g')) AS kx, lower(regexp_replace(expected, '[^A-Za-z0-9]', '', 'g')) AS ke FROM ext),
grams AS (SELECT *, list_distinct(list_transform(range(1, length(kx)), lambda i: substr(kx, i, 2))) AS gx, list_distinct(list_transform(range(1, length(ke)), lambda i: substr(ke, i, 2))) AS ge FROM keyed),
scored AS (SELECT doc_id, expected, length(ke) AS nk, CASE WHEN expected IS NULL THEN NULL WHEN ce = 0 THEN 1.0 ELSE cx / CAST(ce AS DOUBLE) END AS coverage,
  CASE WHEN expected IS NULL THEN NULL WHEN length(kx) < 2 AND length(ke) < 2 THEN 1.0 ELSE len(list_intersect(gx, ge)) / CAST(len(gx) + len(ge) - len(list_intersect(gx, ge)) AS DOUBLE) END AS similarity FROM grams),
tiered AS (SELECT doc_id, coverage, similarity, CASE WHEN expected IS NULL THEN 'Unverified' WHEN nk < 32 THEN 'Ok' WHEN least(coverage, similarity) < 0.5 THEN 'Severe' WHEN least(coverage, similarity) < 0.9 THEN 'Degraded' ELSE 'Ok' END AS tier FROM scored)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "lang", "source", "text"))
    rest = F.col("doc_id") % 5
    third = F.substring("text", F.lit(1), F.floor(F.length("text") / 3).cast("int"))
    extracted = F.when(rest == 0, F.replace("text", F.lit("e"), F.lit(""))).when(rest == 1, third).otherwise(F.col("text"))
    return docs.select("doc_id", "lang", "source", F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("text")).alias("expected"), extracted.alias("extracted"))


@register("c13_extraction_confidence", f"WITH {_KEYS} SELECT doc_id, round(coverage, 6) AS coverage, round(similarity, 6) AS similarity, tier FROM tiered")
def extraction_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, bigram similarity and tier of every document's extraction."""
    return audit.page_confidence(_pages(spark, sf_dir)).select("doc_id", F.round("coverage", 6).alias("coverage"), F.round("similarity", 6).alias("similarity"), "tier")


@register("a17_worst_tier", f"""WITH {_KEYS} SELECT d.source, CASE max(CASE tier WHEN 'Ok' THEN 0 WHEN 'Unverified' THEN 1 WHEN 'Degraded' THEN 2 ELSE 3 END) WHEN 0 THEN 'Ok' WHEN 1 THEN 'Unverified' WHEN 2 THEN 'Degraded' ELSE 'Severe' END AS tier FROM tiered JOIN documents d USING (doc_id) GROUP BY d.source""")
def worst_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst tier of each source."""
    return audit.page_confidence(_pages(spark, sf_dir)).groupBy("source").agg(audit.worst_tier(F.col("tier")).alias("tier"))


@register("c14_policy", f"""WITH {_KEYS} SELECT tier, CASE WHEN tier <> 'Ok' THEN 'Refuse' ELSE 'Proceed' END AS strict, CASE WHEN tier = 'Severe' THEN 'Refuse' WHEN tier = 'Ok' THEN 'Proceed' ELSE 'Warn' END AS usual,
CASE WHEN tier = 'Ok' THEN 'Proceed' ELSE 'Warn' END AS lenient, count(*) AS n FROM tiered GROUP BY 1, 2, 3, 4""")
def confidence_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each policy does with the documents of each tier."""
    tier = F.col("tier")
    scored = audit.page_confidence(_pages(spark, sf_dir))
    return scored.groupBy("tier", audit.policy(tier, "strict").alias("strict"), audit.policy(tier, "default").alias("usual"), audit.policy(tier, "warn").alias("lenient")).agg(F.count("*").alias("n"))


@register("a16_aggregate_coverage", f"WITH {_KEYS} SELECT d.lang, round(sum(cx) / CAST(sum(ce) AS DOUBLE), 6) AS coverage FROM keyed JOIN documents d USING (doc_id) WHERE expected IS NOT NULL GROUP BY d.lang")
def aggregate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters and digits extracted for each expected one, over all documents of a language."""
    known = _pages(spark, sf_dir).where("expected is not null")
    sums = known.groupBy("lang").agg(F.sum(T.letter_digit_count(F.col("extracted"))).alias("x"), F.sum(T.letter_digit_count(F.col("expected"))).alias("e"))
    return sums.select("lang", F.round(F.col("x") / F.col("e"), 6).alias("coverage"))


_BOXES = """items AS (SELECT doc_id, CAST(floor(line_no / 60) + 1 AS INTEGER) AS page_no, line_no AS idx, 72.0 AS l, 720.0 - 12 * (line_no % 60) AS b, 72.0 + 6 * length(text) AS r, 730.0 - 12 * (line_no % 60) AS t FROM (
  SELECT doc_id, unnest(ts) AS text, CAST(unnest(range(len(ts))) AS INTEGER) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS ts FROM documents WHERE text IS NOT NULL)) WHERE length(text) > 0),
covers AS (SELECT doc_id, page_no, idx + 2 AS idx, l + (idx % 3) * 40 AS l, b - 6 * (idx % 2) AS b, r AS r, t AS t FROM items WHERE idx % 4 = doc_id % 4)"""


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = layout.text_lines(table(spark, sf_dir, "documents")).where("length(text) > 0")
    box = G.rect(F.lit(72), 720 - 12 * F.col("row"), 72 + 6 * F.length("text"), 730 - 12 * F.col("row"))
    items = lines.select("doc_id", "page_no", F.col("line_no").alias("idx"), box.alias("box"))
    n, x = F.col("idx"), F.col("box")
    covers = items.where(n % 4 == F.col("doc_id") % 4).select("doc_id", "page_no", (n + 2).alias("idx"), G.rect(x["l"] + (n % 3) * 40, x["b"] - 6 * (n % 2), x["r"], x["t"]).alias("box"))
    return items, covers


@register("j5_hidden_text", f"""WITH {_BOXES}, j AS (SELECT i.doc_id, i.page_no, i.idx, min(c.idx) AS hidden_by FROM items i JOIN covers c ON c.doc_id = i.doc_id AND c.page_no = i.page_no AND c.idx > i.idx
WHERE greatest(least(i.r, c.r) - greatest(i.l, c.l), 0) * greatest(least(i.t, c.t) - greatest(i.b, c.b), 0) / greatest((i.r - i.l) * (i.t - i.b), 1e-6) >= 0.5 GROUP BY 1, 2, 3)
SELECT doc_id, page_no, CAST(idx AS INTEGER) AS idx, CAST(hidden_by AS INTEGER) AS hidden_by FROM j""")
def hidden_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a later obstruction covers by at least half, with the first one that does."""
    items, covers = _boxes(spark, sf_dir)
    return audit.hidden_items(items, covers).select("doc_id", "page_no", "idx", "hidden_by")


@register("j6_unseen_words", """WITH w AS (SELECT DISTINCT lower(trim(unnest(string_split_regex(text, '\\s')), '.,:;!?"''()[]')) AS word FROM documents),
b AS (SELECT item_id, unnest(string_split_regex(text, '\\s')) AS word FROM benchmark)
SELECT item_id, count(*) AS n FROM b WHERE lower(trim(word, '.,:;!?"''()[]')) <> '' AND lower(trim(word, '.,:;!?"''()[]')) NOT IN (SELECT word FROM w WHERE word IS NOT NULL) GROUP BY item_id""")
def unseen_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each benchmark item no document has."""
    seen = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s")).alias("word"))
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", r"\s")).alias("word"))
    return audit.words_not_seen(words, seen, []).groupBy("item_id").agg(F.count("*").alias("n"))


@register("a26_safety_report", """SELECT count(*) AS n_docs, count(*) FILTER (WHERE contains(lower(text), 'idiot')) AS with_term, count(*) FILTER (WHERE contains(text, '@')) AS with_address, count(*) FILTER (WHERE length(trim(text)) = 0 OR text IS NULL) AS empty,
CAST(sum(length(text)) AS BIGINT) AS n_chars, CASE WHEN count(*) FILTER (WHERE text IS NOT NULL) = 0 THEN 'NotChecked' WHEN count(*) FILTER (WHERE contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), 'idiot')) > 0 THEN 'Warning' ELSE 'Verified' END AS verdict, source FROM documents GROUP BY source""")
def safety_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and the verdict on whether a term is left in the texts of a source."""
    text = F.col("text")
    left = F.count_if(F.contains(F.lower(F.regexp_replace(text, r"\s+", " ")), F.lit("idiot")))
    verdict = F.when(F.count("text") == 0, "NotChecked").when(left > 0, "Warning").otherwise("Verified")
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("n_docs"), F.count_if(F.contains(F.lower(text), F.lit("idiot"))).alias("with_term"), F.count_if(F.contains(text, F.lit("@"))).alias("with_address"),
        F.count_if((F.length(F.trim(text)) == 0) | text.isNull()).alias("empty"), F.sum(F.length(text)).alias("n_chars"), verdict.alias("verdict"))


@register("j9_lines_beside_bands", f"""WITH {_BOXES} SELECT i.doc_id, i.page_no, CAST(i.idx AS INTEGER) AS idx FROM items i WHERE NOT EXISTS (SELECT 1 FROM covers c WHERE c.doc_id = i.doc_id AND c.page_no = i.page_no AND i.b < c.t + 1.0 AND i.t > c.b - 1.0)""")
def lines_beside_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose height overlaps no band, with a margin of one."""
    items, covers = _boxes(spark, sf_dir)
    return audit.outside_bands(items, covers, ["doc_id", "page_no"]).select("doc_id", "page_no", "idx")


@register("j7_word_span_join", """WITH l AS (SELECT item_id, text, list_filter(range(1, length(text) - 5), lambda i: substr(text, i, 6) = 'in the') AS s FROM benchmark WHERE contains(text, 'in the')) SELECT item_id, CAST(len(s) AS BIGINT) AS n FROM l""")
def word_span_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches that span words in benchmark items, with the words they touch joined."""
    from pagemill.operators.search import substring_matches
    from pagemill.operators.words import spans_of_matches

    lines = table(spark, sf_dir, "benchmark").select("item_id", "text")
    hits = substring_matches(lines, "in the", ignore_case=False)
    spans = spans_of_matches(hits.select("item_id", "start", "length"), line_words(lines), ["item_id"])
    return spans.groupBy("item_id").agg(F.count("*").alias("n"))
