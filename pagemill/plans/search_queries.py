"""Queries on letters, words, search and redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.functions import text as T
from pagemill.operators import redact, search, words
from pagemill.plans.registry import register
from pagemill.session import table
from pagemill.sources import layout

_LINES = """lines AS (
  SELECT doc_id, CAST(floor(line_no / 60) + 1 AS INTEGER) AS page_no, line_no, line_no % 60 AS row, text FROM (
    SELECT doc_id, unnest(ts) AS text, CAST(unnest(range(len(ts))) AS INTEGER) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS ts FROM documents WHERE text IS NOT NULL)))"""
_LETTERS = _LINES + """, letters AS (
  SELECT doc_id, page_no, line_no, row, i - 1 AS col, text[i] AS value, 72 + 6 * (i - 1) AS l, 720 - 12 * row AS b FROM (
    SELECT doc_id, page_no, line_no, row, text, unnest(range(1, length(text) + 1)) AS i FROM lines))"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


@register("c1_substring_search", f"""WITH {_LINES}, hits AS (
  SELECT doc_id, page_no, line_no, text, unnest(list_filter(range(1, length(text) - 2), lambda i: lower(substr(text, i, 4)) = 'tion')) AS start FROM lines WHERE contains(lower(text), 'tion')
), spans AS (
  SELECT *, string_split_regex(substr(text, 1, CAST(start AS INTEGER) - 1), '\\s')[-1] AS head, string_split_regex(substr(text, CAST(start AS INTEGER) + 4), '\\s')[1] AS tail, greatest(start - 30, 1) AS lo, least(start + 33, length(text)) AS hi FROM hits)
SELECT doc_id, page_no, line_no, CAST(start AS INTEGER) AS start, head || substr(text, CAST(start AS INTEGER), 4) || tail AS first_word, head || substr(text, CAST(start AS INTEGER), 4) || tail AS last_word,
  CASE WHEN lo > 1 THEN '...' ELSE '' END || substr(text, CAST(lo AS INTEGER), CAST(hi - lo + 1 AS INTEGER)) || CASE WHEN hi < length(text) THEN '...' ELSE '' END AS context FROM spans""")
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a term with its words and context."""
    return search.search(_docs(spark, sf_dir), "tion")


@register("c2_whole_word_search", f"""WITH {_LINES}, w AS (SELECT doc_id, page_no, line_no, unnest(string_split_regex(text, '\\s')) AS word FROM lines)
SELECT doc_id, page_no, count(*) AS n FROM w WHERE lower(trim(word, '.,:;!?"''()[]')) = 'idiot' GROUP BY doc_id, page_no""")
def whole_word_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-word matches by page."""
    lines = layout.text_lines(_docs(spark, sf_dir)).select("doc_id", "page_no", "text")
    return words.whole_words_of_lines(lines, "idiot").groupBy("doc_id", "page_no").agg(F.count("*").alias("n"))


@register("c3_regex_search", f"""WITH {_LINES}, m AS (SELECT doc_id, page_no, line_no, regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') AS ms FROM lines)
SELECT doc_id, page_no, line_no, CAST(unnest(range(len(ms))) AS INTEGER) AS match_no, unnest(ms) AS matched FROM m WHERE len(ms) > 0""")
def regex_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail addresses with their places."""
    lines = layout.text_lines(_docs(spark, sf_dir)).select("doc_id", "page_no", "line_no", "text")
    return search.regex_matches(lines, "[A-Za-z0-9._]+@[A-Za-z0-9.]+").drop("text")


@register("c6_overlapping_redaction", f"""WITH {_LINES}, hits AS (
  SELECT doc_id, line_no, text, list_filter(range(1, length(text) - 1), lambda i: substr(text, i, 3) = 'ere') AS s FROM lines WHERE contains(text, 'ere'))
SELECT doc_id, line_no, CAST(len(s) AS INTEGER) AS n_matches, list_aggregate(list_transform(range(1, length(text) + 1), lambda i: CASE WHEN len(list_filter(s, lambda x: i >= x AND i < x + 3)) > 0 THEN '#' ELSE text[i] END), 'string_agg', '') AS redacted FROM hits""")
def overlapping_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a term, every letter of every overlapping match masked."""
    lines = layout.text_lines(_docs(spark, sf_dir)).select("doc_id", "line_no", "text").where(F.contains("text", F.lit("ere")))
    return redact.redacted_lines(lines, "ere", "#").select("doc_id", "line_no", "n_matches", "redacted")


_CUT = ["idiot", "moron", "anan"]


def _cut_sql(passes: int = 10) -> str:
    steps, n = ["s0 AS (SELECT doc_id, text AS t, 0 AS n FROM documents)"], 0
    for _ in range(passes):
        for term in _CUT:
            steps.append(f"s{n + 1} AS (SELECT doc_id, replace(t, '{term}', '') AS t, n + (length(t) - length(replace(t, '{term}', ''))) // {len(term)} AS n FROM s{n})")
            n += 1
    left = " + ".join(f"CASE WHEN contains(t, '{term}') THEN 1 ELSE 0 END" for term in _CUT)
    return f"WITH {', '.join(steps)} SELECT doc_id, t AS redacted, CAST(n AS INTEGER) AS n_removed, CAST({left} AS INTEGER) AS n_left FROM s{n}"


@register("c8_document_redaction", _cut_sql())
def document_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a few terms, pass after pass."""
    return redact.redact_all(_docs(spark, sf_dir), _CUT)


_NESTED = ["ther", "onon", "Anan", "idiot"]
_COVERED = " OR ".join(f"lower(substr(t, i - {k}, {len(term)})) = '{term.lower()}' AND i > {k}" for term in _NESTED for k in range(len(term)))
_STARTS = " + ".join(f"len(list_filter(range(1, length(t) - {len(term) - 2}), lambda i: lower(substr(t, i, {len(term)})) = '{term.lower()}'))" for term in _NESTED)
_ANY = " OR ".join(f"contains(lower(t), '{term.lower()}')" for term in _NESTED)


@register("c8_fixed_point", f"""WITH RECURSIVE {_LINES}, cut AS (SELECT doc_id, line_no, text AS t, 0 AS n, 0 AS k FROM lines
  UNION ALL SELECT doc_id, line_no, coalesce(list_aggregate(list_transform(list_filter(range(1, length(t) + 1), lambda i: NOT ({_COVERED})), lambda i: t[i]), 'string_agg', ''), ''), n + {_STARTS}, k + 1 FROM cut WHERE k < 2 AND ({_ANY})),
last AS (SELECT doc_id, line_no, max(k) AS k FROM cut GROUP BY 1, 2), ends AS (SELECT c.*, ({_ANY}) AS swept, n + CASE WHEN {_ANY} THEN {_STARTS} ELSE 0 END AS total FROM cut c JOIN last USING (doc_id, line_no, k))
SELECT doc_id, CAST(sum(total) AS BIGINT) AS n_matches, CAST(max(k) AS INTEGER) AS passes, CAST(count(*) FILTER (WHERE swept) AS BIGINT) AS n_swept, md5(string_agg(CASE WHEN swept THEN '' ELSE t END, chr(10) ORDER BY line_no)) AS digest FROM ends GROUP BY doc_id""")
def fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without any of some terms, also those that only the cutting made: two passes by letters, then lines that still have one go."""
    lines = layout.text_lines(_docs(spark, sf_dir)).select("doc_id", "line_no", "text")
    done = redact.redact_to_the_end(lines, _NESTED, passes=2)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "redacted"))), lambda x: x["redacted"]), "\n")
    return done.groupBy("doc_id").agg(F.sum("n_matches").cast("long").alias("n_matches"), F.max("passes").alias("passes"), F.count_if("swept").alias("n_swept"), F.md5(text).alias("digest"))


@register("c6_folded_redaction", f"""WITH {_LINES}, odd AS (SELECT doc_id, line_no, replace(replace(text, 'st', 'ﬆ'), 'é', 'e' || chr(769)) AS text FROM lines)
SELECT doc_id, line_no, CAST((length(text) - length(replace(text, 'ﬆer', ''))) // 3 AS INTEGER) AS n_matches, replace(text, 'ﬆer', '###') AS redacted FROM odd WHERE contains(text, 'ﬆer')""")
def folded_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters masked for a plain term in texts with ligatures and decomposed accents."""
    lines = layout.text_lines(_docs(spark, sf_dir)).select("doc_id", "line_no", F.replace(F.replace("text", F.lit("st"), F.lit("ﬆ")), F.lit("é"), F.lit("e\u0301")).alias("text"))
    return redact.redacted_lines(lines, "ster", "#").where("n_matches > 0").select("doc_id", "line_no", "n_matches", "redacted")


@register("c15_term_scrub", """SELECT doc_id, CASE WHEN s = '' AND text <> '' THEN '[redacted]' ELSE s END AS text FROM (
  SELECT doc_id, text, trim(replace(replace(text, 'idiot', ''), 'stupid', '')) AS s FROM documents)""")
def term_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms removed in order; what becomes empty is marked."""
    return redact.scrubbed(_docs(spark, sf_dir).select("doc_id", "text"), ["text"], ["idiot", "stupid", "no"], "[redacted]")


@register("w1_words", f"""WITH {_LETTERS}, lagged AS (
  SELECT *, value = ' ' AS space, lag(value) OVER o AS pv, lag(b) OVER o AS pb, lag(l) OVER o AS pl FROM letters WINDOW o AS (PARTITION BY doc_id, page_no ORDER BY line_no, col)
), marked AS (
  SELECT *, CASE WHEN NOT space AND (pv IS NULL OR pv = ' ' OR abs(b - pb) > 5 OR l - (pl + 5) > 3) THEN 1 ELSE 0 END AS fresh FROM lagged
), numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page_no ORDER BY line_no, col) AS word_no FROM marked
)
SELECT doc_id, page_no, CAST(count(DISTINCT word_no) AS BIGINT) AS n_words, CAST(count(*) AS BIGINT) AS n_letters, CAST(sum(word_no * (col + 1)) AS BIGINT) AS checksum FROM numbered WHERE NOT space GROUP BY doc_id, page_no""")
def word_building(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every page, built from letters by gaps."""
    found = words.words_on_lines(layout.page_lines(_docs(spark, sf_dir)))
    n = F.length("text").cast("long")
    first = F.col("first_col").cast("long") + 1
    places = F.col("word_no") * (n * first + n * (n - 1) / 2)
    return found.groupBy("doc_id", "page_no").agg(F.count("*").alias("n_words"), F.sum(n).alias("n_letters"), F.sum(places).cast("long").alias("checksum"))


@register("a18_bounding_boxes", f"""WITH {_LETTERS} SELECT doc_id, page_no, CAST(min(l) AS DOUBLE) AS l, CAST(min(b) AS DOUBLE) AS b, CAST(max(l) + 5 AS DOUBLE) AS r, CAST(max(b) + 10 AS DOUBLE) AS t FROM letters WHERE value <> ' ' GROUP BY doc_id, page_no""")
def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rectangle around each page's letters."""
    return layout.letters(_docs(spark, sf_dir), keep_spaces=False).groupBy("doc_id", "page_no").agg(G.bounding("box").alias("x")).select("doc_id", "page_no", "x.l", "x.b", "x.r", "x.t")


@register("a19_ordered_concat", f"WITH {_LINES} SELECT doc_id, page_no, string_agg(text, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY doc_id, page_no")
def ordered_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of text, joined from their lines in order."""
    return layout.pages(_docs(spark, sf_dir))


def _area(left: int = 142, bottom: int = 420, right: int = 325, top: int = 605):
    return G.rect(F.lit(left), F.lit(bottom), F.lit(right), F.lit(top))


@register("j8_letters_in_area", f"""WITH {_LETTERS} SELECT doc_id, page_no, CAST(count(*) AS BIGINT) AS n, CAST(sum(col) AS BIGINT) AS cols FROM letters
WHERE l + 2.5 >= 142 AND l + 2.5 <= 325 AND b + 5 >= 420 AND b + 5 <= 605 GROUP BY doc_id, page_no""")
def letters_in_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters whose centre lies in an area, by page."""
    found = layout.letters(_docs(spark, sf_dir)).where(G.removed(F.col("box"), _area(), "CenterPoint"))
    return found.groupBy("doc_id", "page_no").agg(F.count("*").alias("n"), F.sum("col").cast("long").alias("cols"))


@register("p4_spatial_filter", f"""WITH {_LETTERS} SELECT doc_id, CAST(count(*) FILTER (WHERE NOT (142 < l + 5 AND 325 > l AND 420 < b + 10 AND 605 > b)) AS BIGINT) AS not_crossing,
  CAST(count(*) FILTER (WHERE NOT (l >= 142 AND l + 5 <= 325 AND b >= 420 AND b + 10 <= 605)) AS BIGINT) AS not_inside FROM letters GROUP BY doc_id""")
def spatial_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many letters stay when those that cross, or lie in, an area go."""
    flags = layout.letters(_docs(spark, sf_dir)).select("doc_id", (~G.intersects(_area(), F.col("box"))).alias("x"), (~G.contains(_area(), F.col("box"))).alias("y"))
    return flags.groupBy("doc_id").agg(F.count_if("x").alias("not_crossing"), F.count_if("y").alias("not_inside"))


@register("p12_removal_strategies", f"""WITH {_LETTERS}, f AS (SELECT doc_id, 142 < l + 5 AND 325 > l AND 420 < b + 10 AND 605 > b AS x, l >= 142 AND l + 5 <= 325 AND b >= 420 AND b + 10 <= 605 AS y,
  l + 2.5 >= 142 AND l + 2.5 <= 325 AND b + 5 >= 420 AND b + 5 <= 605 AS z FROM letters)
SELECT doc_id, CAST(count(*) FILTER (WHERE x) AS BIGINT) AS any_overlap, CAST(count(*) FILTER (WHERE y) AS BIGINT) AS fully_contained, CAST(count(*) FILTER (WHERE z) AS BIGINT) AS center_point FROM f GROUP BY doc_id""")
def removal_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters that each removal strategy takes."""
    box = F.col("box")
    return layout.letters(_docs(spark, sf_dir)).groupBy("doc_id").agg(*(F.count_if(G.removed(box, _area(), s)).alias(n) for s, n in (("AnyOverlap", "any_overlap"), ("FullyContained", "fully_contained"), ("CenterPoint", "center_point"))))


@register("w2_segments", f"""WITH {_LETTERS}, f AS (
  SELECT doc_id, line_no, col, value, CASE WHEN NOT (140 < l + 5 AND 323 > l AND 420 < b + 10 AND 605 > b) THEN 'kept' WHEN l >= 140 AND l + 5 <= 323 AND b >= 420 AND b + 10 <= 605 THEN 'Full' ELSE 'Partial' END AS fate FROM letters
), m AS (SELECT *, CASE WHEN fate = lag(fate) OVER (PARTITION BY doc_id, line_no ORDER BY col) THEN 0 ELSE 1 END AS fresh FROM f
), n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, line_no ORDER BY col) AS segment_no FROM m)
SELECT doc_id, line_no, CAST(segment_no AS BIGINT) AS segment_no, fate = 'kept' AS kept, CASE WHEN fate = 'kept' THEN 'None' ELSE fate END AS overlap, CAST(min(col) AS INTEGER) AS start, CAST(max(col) + 1 AS INTEGER) AS stop, string_agg(value, '' ORDER BY col) AS text
FROM n GROUP BY doc_id, line_no, segment_no, fate""")
def keep_remove_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of letters of each line with one fate under area redaction."""
    lines = layout.line_letters(_docs(spark, sf_dir)).select("doc_id", "line_no", "letters")
    return redact.line_segments(lines, ["doc_id", "line_no"], _area(140, 420, 323, 605))


@register("f5_redaction_form", """SELECT doc_id, md5(regexp_replace(trim(replace(replace(replace(text, '’', ''''), '–', '-'), '—', '-')), '\\s+', ' ', 'g')) AS digest FROM documents""")
def redaction_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each text's form for matching."""
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.redaction_form(F.col("text"))).alias("digest"))


@register("f1_fold", """SELECT doc_id, md5(nfc_normalize(replace(replace(replace(replace(replace(replace(text, chr(160), ' '), chr(173), ''), chr(8203), ''), chr(8204), ''), chr(8205), ''), chr(65279), ''))) AS digest FROM documents""")
def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each text's folded form."""
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.fold(F.col("text"))).alias("digest"))


@register("f14_edge_trim", """WITH w AS (SELECT unnest(string_split(text, ' ')) AS w FROM documents) SELECT trim(w, '.,:;!?"''()[]') AS word, count(*) AS n FROM w GROUP BY 1""")
def edge_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of words without edge punctuation."""
    return _docs(spark, sf_dir).select(F.explode(F.split("text", " ")).alias("w")).groupBy(T.trim_edges(F.col("w")).alias("word")).agg(F.count("*").alias("n"))


@register("p8_find_text", "SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'license')")
def find_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text contains a needle, whatever its case."""
    return _docs(spark, sf_dir).where(F.contains(F.lower("text"), F.lit("license"))).select("doc_id", "lang", "source")
