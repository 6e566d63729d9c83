"""Removal of repeated line runs: a suffix array over line-id sequences by distributed prefix doubling, in DataFrame operations.

A position is a non-blank line of a document; its suffix is the sequence of line ids from there on. Ranks are classes of suffixes
that agree on their first `span` lines; a class is named by its ids' hash and knows its first position in (doc_id, line) order.
Positions whose class has one member drop out before the next round; each round pairs the rank at a position with the rank
`span` lines on and so doubles the span, until it reaches the least run length. The classes left are the intervals of suffixes with a longest
common prefix of at least that length: the first position of a class is the run that stays, the others start later copies.
Windows of later copies that overlap or touch add up to the maximal repeated runs, which are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import stored


def _lines(text: Column) -> Column:
    """Non-blank lines with their number in the text."""
    numbered = F.transform(F.split(text, "\n", -1), lambda t, i: F.struct(i.alias("line"), t.alias("t")))
    return F.filter(numbered, lambda x: F.trim(x["t"]) != "")


def _ranked(positions: DataFrame) -> DataFrame:
    """positions (doc_id, seq, name, ...) of classes with at least two members, with the class's first position."""
    classes = positions.groupBy("name").agg(F.count("*").alias("_n"), F.min(F.struct("doc_id", "seq")).alias("first")).where("_n > 1")
    return positions.drop("first").join(classes.drop("_n"), "name")


def repeated_lines(docs: DataFrame, min_lines: int = 2, min_chars: int = 200) -> DataFrame:
    """(doc_id, line) of lines in later copies: of runs of at least min_lines lines, or of single lines of at least min_chars."""
    given = docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.transform(_lines(F.col("text")), lambda x: F.struct(x["line"].alias("line"), F.xxhash64(x["t"]).alias("h"), F.length(x["t"]).alias("n")))).alias("seq", "x"))
    positions = given.select("doc_id", "seq", F.col("x.line").alias("line"), F.xxhash64("x.h", "x.n").alias("name"), F.col("x.n").alias("n")).distinct()
    single = stored(_ranked(positions))
    later = F.struct("doc_id", "seq") > F.col("first")
    found = single.where((F.col("n") >= min_chars) & later).select("doc_id", "seq")
    now, span = single.select("doc_id", "seq", "name", "first"), 1
    while span < min_lines:
        step = min(span, min_lines - span)
        ahead = now.select("doc_id", (F.col("seq") - step).alias("seq"), F.col("name").alias("name2"))
        pairs = now.join(ahead, ["doc_id", "seq"]).select("doc_id", "seq", F.xxhash64("name", "name2", F.lit(span)).alias("name"))
        now, span = stored(_ranked(pairs)), span + step
    covered = now.where(later).select("doc_id", F.explode(F.sequence(F.col("seq"), F.col("seq") + (min_lines - 1))).alias("seq"))
    gone = found.unionByName(covered).distinct()
    return gone.join(single.select("doc_id", "seq", "line"), ["doc_id", "seq"])


def remove_repeated_lines(docs: DataFrame, min_lines: int = 2, min_chars: int = 200) -> DataFrame:
    """docs with text without later copies of repeated lines, and n_lines, n_removed, n_runs.

    Lines are split at \\n; blank lines (spaces only) count for nothing and stay. A text that loses all other lines becomes
    empty. Earlier is by (doc_id, line), so the copy that stays is the first. Rows that repeat an id repeat its text and get the same
    result. Null texts stay null with no lines; rows with a null id are kept as they are. Columns of docs other than doc_id and text
    pass through; n_lines, n_removed and n_runs are replaced where docs has them. An empty table gives no rows.
    """
    found = repeated_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), min_lines, min_chars)
    runs = found.withColumn("_new", (F.col("seq") != F.coalesce(F.lag("seq").over(Window.partitionBy("doc_id").orderBy("seq")) + 1, F.lit(-1))).cast("int"))
    gone = runs.groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(F.collect_list("line").alias("_gone"), F.sum("_new").alias("_runs"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    joined = whole.join(gone, F.col("row.doc_id").cast("long") == F.col("_doc"), "left")
    joined = joined.withColumn("lines", F.split(F.col("row.text").cast("string"), "\n", -1))
    n_lines = F.coalesce(F.size(F.filter("lines", lambda t: F.trim(t) != "")), F.lit(0))
    joined = joined.withColumn("n_lines", F.when(F.col("row.text").isNull(), 0).otherwise(n_lines))
    joined = joined.withColumn("n_removed", F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "_gone"), lambda i: F.get("lines", i))
    text = F.when(F.col("_gone").isNull(), F.col("row.text")).when(F.col("n_removed") == F.col("n_lines"), "").otherwise(F.array_join(kept, "\n"))
    given = [(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c.lower() not in ("n_lines", "n_removed", "n_runs")]
    return joined.select(*given, "n_lines", "n_removed", F.coalesce("_runs", F.lit(0)).cast("int").alias("n_runs"))


def oracle_sql(min_lines: int = 2, min_chars: int = 200) -> str:
    """The same result in DuckDB for runs of at least two lines: doc_id, n_lines, n_removed, n_runs, kept_sha256."""
    if min_lines != 2:
        raise ValueError("the SQL is written for two lines")
    return f"""
WITH parts AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ts FROM documents WHERE text IS NOT NULL
), lines AS (
  SELECT doc_id, unnest(ts) AS t, unnest(range(len(ts))) AS line FROM parts
), seqs AS (
  SELECT doc_id, line, t, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS seq FROM lines WHERE trim(t) <> ''
), pairs AS (
  SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY seq) AS t2, doc_id * 100000000 + seq AS pos FROM seqs
), firsts AS (
  SELECT *, min(pos) OVER (PARTITION BY t) AS first1, min(pos) OVER (PARTITION BY t, t2) AS first2 FROM pairs
), gone AS (
  SELECT doc_id, seq FROM firsts WHERE length(t) >= {min_chars} AND pos > first1
  UNION SELECT doc_id, seq FROM firsts WHERE t2 IS NOT NULL AND pos > first2
  UNION SELECT doc_id, seq + 1 FROM firsts WHERE t2 IS NOT NULL AND pos > first2
), runs AS (
  SELECT doc_id, seq, CASE WHEN seq - 1 = lag(seq) OVER (PARTITION BY doc_id ORDER BY seq) THEN 0 ELSE 1 END AS fresh FROM gone
), per_doc AS (
  SELECT doc_id, count(*) AS n_removed, sum(fresh) AS n_runs FROM runs GROUP BY doc_id
), counted AS (
  SELECT doc_id, count(*) AS n_lines FROM seqs GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, string_agg(l.t, chr(10) ORDER BY l.line) AS text FROM lines l LEFT JOIN seqs s ON s.doc_id = l.doc_id AND s.line = l.line
  LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.seq = s.seq WHERE g.doc_id IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(c.n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(p.n_removed, 0) AS INTEGER) AS n_removed, CAST(coalesce(p.n_runs, 0) AS INTEGER) AS n_runs,
  sha256(CASE WHEN p.n_removed IS NULL THEN d.text WHEN p.n_removed = c.n_lines THEN '' ELSE k.text END) AS kept_sha256
FROM documents d LEFT JOIN counted c ON c.doc_id = d.doc_id LEFT JOIN per_doc p ON p.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
