"""Queries on a stored word index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.text_index import TextIndex
from pagemill.plans.registry import register
from pagemill.session import table
from pagemill.storage import shared_folder

_MAIL = "[A-Za-z0-9._]+@[A-Za-z0-9.]+"
_INDEXED = """indexed AS (SELECT doc_id, text FROM documents WHERE lang IS DISTINCT FROM 'es' UNION ALL SELECT 1000000000 + item_id, text FROM benchmark),
lines AS (SELECT doc_id, unnest(ts) AS text, CAST(unnest(range(len(ts))) AS INTEGER) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS ts FROM indexed WHERE text IS NOT NULL))"""


def _index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """All documents in one batch, the benchmark's items in another, then the Spanish documents taken out again."""
    index = TextIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", buckets=16)
    docs = table(spark, sf_dir, "documents")
    index.add(docs.select("doc_id", "text"), batch=0)
    index.add(table(spark, sf_dir, "benchmark").select((F.lit(1_000_000_000) + F.col("item_id")).alias("doc_id"), "text"), batch=1)
    index.remove(docs.where("lang = 'es'"), batch=2)
    return index


@register("c5_positional_index", f"""WITH {_INDEXED}, parts AS (SELECT doc_id, line_no, text, string_split(lower(text), 'tion') AS xs FROM lines WHERE contains(lower(text), 'tion')),
subs AS (SELECT 'substring' AS mode, doc_id, line_no, list_sum(list_transform(xs[1:k], lambda x: length(x) + 4)) - 3 AS start, 4 AS length, NULL AS matched FROM (SELECT *, unnest(range(1, len(xs))) AS k FROM parts)),
phrase AS (SELECT 'phrase' AS mode, doc_id, line_no, list_sum(list_transform(xs[1:k], lambda x: length(x) + 4)) - 3 AS start, 4 AS length, NULL AS matched FROM (SELECT *, unnest(range(1, len(xs))) AS k FROM (SELECT doc_id, line_no, string_split(lower(text), 's th') AS xs FROM lines WHERE contains(lower(text), 's th')))),
tokens AS (SELECT doc_id, line_no, unnest(string_split_regex(text, '\\s')) AS word FROM lines),
found AS (SELECT 'word' AS mode, doc_id, line_no, CAST(NULL AS BIGINT) AS start, length(word) AS length, word AS matched FROM tokens WHERE lower(trim(word, '.,:;!?"''()[]')) = 'the'),
mails AS (SELECT 'regex' AS mode, doc_id, line_no, CAST(unnest(range(len(ms))) AS BIGINT) AS start, length(unnest(ms)) AS length, unnest(ms) AS matched FROM (SELECT doc_id, line_no, regexp_extract_all(text, '{_MAIL}') AS ms FROM lines) WHERE len(ms) > 0)
SELECT mode, doc_id, line_no, CAST(start AS INTEGER) AS start, CAST(length AS INTEGER) AS length, matched, count(*) AS n FROM (SELECT * FROM subs UNION ALL SELECT * FROM phrase UNION ALL SELECT * FROM found UNION ALL SELECT * FROM mails) GROUP BY ALL""")
def positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places that an index gives for a part of a word, for one over two words, for a whole word and for an expression."""
    index = _index(spark, sf_dir)
    nothing = F.lit(None).cast("string").alias("matched")
    rows = index.substrings("tion").select(F.lit("substring").alias("mode"), "doc_id", "line_no", "start", "length", nothing)
    rows = rows.unionByName(index.substrings("s th").select(F.lit("phrase").alias("mode"), "doc_id", "line_no", "start", "length", nothing))
    rows = rows.unionByName(index.whole_words("the").select(F.lit("word").alias("mode"), "doc_id", "line_no", F.lit(None).cast("int").alias("start"), F.length("word").alias("length"), F.col("word").alias("matched")))
    rows = rows.unionByName(index.regex(_MAIL, literal="@").select(F.lit("regex").alias("mode"), "doc_id", "line_no", F.col("match_no").alias("start"), F.length("matched").alias("length"), "matched"))
    return rows.groupBy("mode", "doc_id", "line_no", "start", "length", "matched").agg(F.count("*").alias("n"))


@register("c5_index_frequencies", f"""WITH {_INDEXED}, w AS (SELECT doc_id, lower(trim(unnest(string_split_regex(text, '\\s')), '.,:;!?"''()[]')) AS word FROM lines)
SELECT word, count(DISTINCT doc_id) AS docs, count(*) AS occurrences FROM w WHERE word IN ('the', 'license', 'idiot', 'nowhere', 'est') GROUP BY 1""")
def index_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents, and how often, words stand; only the words' buckets are read."""
    return _index(spark, sf_dir).frequencies(["The", "license", "idiot", "nowhere", "est"])
