"""Queries on the graphics state of pages and on the objects that pages are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import graph, graphics, safety
from pagemill.plans.registry import register
from pagemill.session import table
from pagemill.sources import markup
from pagemill.storage import stored

_TOKENS = """pieces AS (SELECT page_id, k - 1 AS piece_no, ps[k] AS piece FROM (SELECT page_id, ps, unnest(range(1, len(ps) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(html, '<[^>]*>|[^<]+') AS ps FROM pages WHERE html IS NOT NULL))),
tagged AS (SELECT *, regexp_extract(piece, '^</?([a-z][a-z0-9]*)', 1) AS tag, starts_with(piece, '</') AS closes FROM pieces)"""
_SCAN = _TOKENS + """, opened AS (SELECT page_id, piece_no, piece,
  CASE WHEN NOT starts_with(piece, '<') THEN [{'name': 'Tj', 'v': [0.0::DOUBLE, 0, 6 * length(piece), 10]}]
       WHEN tag = '' THEN [] WHEN closes THEN [{'name': 'Q', 'v': []::DOUBLE[]}]
       WHEN tag = 'meta' THEN [{'name': 'BI', 'v': []::DOUBLE[]}] WHEN tag = 'img' THEN [{'name': 'Do', 'v': []::DOUBLE[]}]
       ELSE list_concat(CASE WHEN tag = 'br' THEN [] ELSE [{'name': 'q', 'v': []::DOUBLE[]}, {'name': 'cm', 'v': CASE tag WHEN 'div' THEN [1.0::DOUBLE, 0, 0, 1, 16, -8] WHEN 'p' THEN [1.0::DOUBLE, 0, 0, 1, 0, -12] WHEN 'b' THEN [0.0::DOUBLE, 1, -1, 0, 8, 8]
            WHEN 'ul' THEN [2.0::DOUBLE, 0, 0, 2, 0, 0] WHEN 'h1' THEN [1.5::DOUBLE, 0, 0, 1.5, 0, 0] WHEN 'footer' THEN [1.0::DOUBLE, 0.5, 0, 1, 0, 0] ELSE [1.0::DOUBLE, 0, 0, 1, 4, -4] END}] END,
          CASE tag WHEN 'h1' THEN [{'name': 'rgb', 'v': [0.5::DOUBLE, 0.25, 0]}, {'name': 're', 'v': [0.0::DOUBLE, -4, 240, 24]}, {'name': 'f', 'v': []::DOUBLE[]}]
                   WHEN 'br' THEN [{'name': 'rgb', 'v': [0.0::DOUBLE, 0, 0]}, {'name': 're', 'v': [0.0::DOUBLE, -16, 400, 64]}, {'name': 'f', 'v': []::DOUBLE[]}]
                   WHEN 'footer' THEN [{'name': 'rgb', 'v': [1.0::DOUBLE, 1, 1]}, {'name': 're', 'v': [0.0::DOUBLE, 0, 400, 40]}, {'name': 'f', 'v': []::DOUBLE[]}]
                   WHEN 'article' THEN [{'name': 'rgb', 'v': [0.25::DOUBLE, 0.25, 0.25]}, {'name': 're', 'v': [0.0::DOUBLE, -40, 60, 60]}, {'name': 'f', 'v': []::DOUBLE[]}] ELSE [] END) END AS ops FROM tagged),
flat AS (SELECT page_id, piece_no, piece, j, ops[j].name AS name, ops[j].v AS v FROM (SELECT *, unnest(range(1, len(ops) + 1)) AS j FROM opened)),
numbered AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY piece_no, j) - 1 AS INTEGER) AS i, name, v, CASE WHEN name = 'Tj' THEN piece END AS text FROM flat),
state AS (SELECT page_id, -1 AS i, '' AS name, []::DOUBLE[] AS v, NULL::VARCHAR AS text, [1.0::DOUBLE, 0, 0, 1, 0, 0] AS m, []::DOUBLE[][] AS saved, [1.0::DOUBLE, 1, 1] AS colour FROM (SELECT DISTINCT page_id FROM numbered)
  UNION ALL SELECT n.page_id, n.i, n.name, n.v, n.text,
    CASE n.name WHEN 'Q' THEN coalesce(s.saved[-1], s.m) WHEN 'cm' THEN [n.v[1] * s.m[1] + n.v[2] * s.m[3], n.v[1] * s.m[2] + n.v[2] * s.m[4], n.v[3] * s.m[1] + n.v[4] * s.m[3], n.v[3] * s.m[2] + n.v[4] * s.m[4], n.v[5] * s.m[1] + n.v[6] * s.m[3] + s.m[5], n.v[5] * s.m[2] + n.v[6] * s.m[4] + s.m[6]] ELSE s.m END,
    CASE n.name WHEN 'q' THEN list_append(s.saved, s.m) WHEN 'Q' THEN s.saved[:-2] ELSE s.saved END, CASE n.name WHEN 'rgb' THEN n.v ELSE s.colour END
  FROM state s JOIN numbered n ON n.page_id = s.page_id AND n.i = s.i + 1),
drawn AS (SELECT page_id, i, CASE name WHEN 'Tj' THEN 'text' WHEN 're' THEN 'fill' ELSE 'image' END AS kind, text, len(saved) AS depth, m, colour, CASE WHEN name IN ('Tj', 're') THEN v ELSE [0.0::DOUBLE, 0, 1, 1] END AS v FROM state
  WHERE name IN ('Tj', 'BI', 'Do') OR name = 're' AND list_min(colour) < 0.95),
corners AS (SELECT *, list_transform([[v[1], v[2]], [v[1] + v[3], v[2]], [v[1], v[2] + v[4]], [v[1] + v[3], v[2] + v[4]]], lambda p: [m[1] * p[1] + m[3] * p[2] + m[5], m[2] * p[1] + m[4] * p[2] + m[6]]) AS ps FROM drawn),
found AS (SELECT page_id, CASE WHEN kind = 'fill' THEN i + 1 ELSE i END AS op_idx, kind, text, depth, colour, list_min(list_transform(ps, lambda p: p[1])) AS l, list_min(list_transform(ps, lambda p: p[2])) AS b, list_max(list_transform(ps, lambda p: p[1])) AS r, list_max(list_transform(ps, lambda p: p[2])) AS t FROM corners)"""


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphics.scan(markup.page_operators(table(spark, sf_dir, "pages")), ["page_id"])


@register("w11_graphics_state", f"WITH RECURSIVE {_SCAN} SELECT page_id, CAST(op_idx AS INTEGER) AS op_idx, kind, md5(text) AS text_md5, CAST(depth AS INTEGER) AS depth, l, b, r, t FROM found")
def graphics_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, fills and images of every page with their boxes under the matrices that hold there."""
    return _scanned(spark, sf_dir).select("page_id", "op_idx", "kind", F.md5("text").alias("text_md5"), "depth", "box.l", "box.b", "box.r", "box.t")


@register("c10_hidden_texts", f"""WITH RECURSIVE {_SCAN}, pairs AS (SELECT x.page_id, x.op_idx, x.text, min(c.op_idx) AS hidden_by FROM found x JOIN found c ON c.page_id = x.page_id AND x.kind = 'text' AND c.kind <> 'text' AND c.op_idx > x.op_idx
  WHERE greatest(least(x.r, c.r) - greatest(x.l, c.l), 0) * greatest(least(x.t, c.t) - greatest(x.b, c.b), 0) / greatest((x.r - x.l) * (x.t - x.b), 1e-6) >= 0.5 GROUP BY 1, 2, 3)
SELECT p.page_id, CAST(p.op_idx AS INTEGER) AS op_idx, md5(p.text) AS text_md5, CAST(p.hidden_by AS INTEGER) AS hidden_by,
  CASE WHEN c.kind = 'image' THEN 'image' WHEN list_max(c.colour) = 0 THEN 'black filled rectangle' WHEN list_min(c.colour) = list_max(c.colour) THEN printf('gray(%.2f) filled rectangle', c.colour[1]) ELSE printf('rgb(%.2f,%.2f,%.2f) filled rectangle', c.colour[1], c.colour[2], c.colour[3]) END AS what
FROM pairs p JOIN found c ON c.page_id = p.page_id AND c.op_idx = p.hidden_by""")
def hidden_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that something painted later covers by at least half, wherever the page was moved, turned or scaled to."""
    return graphics.hidden_texts(_scanned(spark, sf_dir), ["page_id"]).select("page_id", "op_idx", F.md5("text").alias("text_md5"), "hidden_by", "what")


@register("c16_safety_report", f"""WITH RECURSIVE {_SCAN}, bodies AS (SELECT page_id AS doc_id, regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), 'e', '', 'g') AS text, len(regexp_extract_all(html, '<meta')) AS info, contains(html, 'lang=') AS xmp, len(regexp_extract_all(html, '<script')) AS embedded FROM pages),
asked AS (SELECT page_id AS doc_id, CASE WHEN op_idx % 7 = 0 THEN 2 ELSE 1 END AS page_no, l, b, r, t, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS term FROM found WHERE kind = 'text' AND length(text) <= 12),
areas AS (SELECT doc_id, count(*) AS n_areas, count(*) FILTER (WHERE page_no = 2) AS skipped, list_filter(list_distinct(list(term)), lambda x: x <> '') AS terms FROM asked GROUP BY 1),
hid AS (SELECT page_id AS doc_id, count(DISTINCT op_idx) AS n FROM (SELECT x.page_id, x.op_idx FROM found x JOIN found c ON c.page_id = x.page_id AND x.kind = 'text' AND c.kind <> 'text' AND c.op_idx > x.op_idx
  WHERE greatest(least(x.r, c.r) - greatest(x.l, c.l), 0) * greatest(least(x.t, c.t) - greatest(x.b, c.b), 0) / greatest((x.r - x.l) * (x.t - x.b), 1e-6) >= 0.5) GROUP BY 1),
img AS (SELECT a.doc_id, count(*) AS n FROM asked a JOIN found f ON f.page_id = a.doc_id AND f.kind = 'image' AND a.page_no = 1 AND a.l < f.r AND a.r > f.l AND a.b < f.t AND a.t > f.b GROUP BY 1),
s AS (SELECT d.doc_id, coalesce(n_areas, 0) AS n_areas, coalesce(skipped, 0) AS skipped, coalesce(terms, []) AS terms, trim(regexp_replace(lower(d.text), '\\s+', ' ', 'g')) AS text, info, xmp, embedded, coalesce(hid.n, 0) AS hidden, coalesce(img.n, 0) AS images FROM bodies d LEFT JOIN areas USING (doc_id) LEFT JOIN hid USING (doc_id) LEFT JOIN img USING (doc_id)),
k AS (SELECT *, len(list_filter(terms, lambda x: length(x) >= 3)) AS checked, len(list_filter(terms, lambda x: length(x) >= 3 AND contains(text, x))) AS remaining FROM s)
SELECT doc_id, n_areas, skipped AS n_areas_skipped, len(terms) AS n_previews, checked AS n_previews_checked, remaining AS n_previews_left, len(terms) - checked AS n_previews_short, CASE WHEN checked = 0 THEN 'NotChecked' WHEN remaining > 0 THEN 'Warning' ELSE 'Verified' END AS content_status,
  CASE WHEN hidden > 0 THEN 'Warning' ELSE 'Verified' END AS hidden_text_status, CASE WHEN n_areas = 0 THEN 'NotChecked' WHEN images > 0 THEN 'Warning' ELSE 'Verified' END AS image_status, true AS metadata_scrubbed, info AS info_fields_scrubbed, xmp AS had_xmp, true AS attachments_scrubbed, embedded AS n_embedded_before,
  hidden AS n_hidden, images AS n_image_overlaps, concat_ws('; ', CASE WHEN skipped > 0 THEN skipped || ' areas skipped, as their page does not exist' END, CASE WHEN remaining > 0 THEN remaining || ' captured previews still in the text' END, CASE WHEN hidden > 0 THEN hidden || ' hidden texts left to look at' END, CASE WHEN images > 0 THEN images || ' images still cross redacted areas' END) AS warnings,
  skipped + remaining + hidden + images > 0 AS has_warnings FROM k""")
def safety_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The safety report on every page as a document whose short texts were to go, in a copy that has lost one letter throughout."""
    pages = table(spark, sf_dir, "pages")
    scan = stored(_scanned(spark, sf_dir))
    html = F.col("html")
    docs = pages.select(F.col("page_id").alias("doc_id"), F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), "e", "").alias("text"), F.lit(1).alias("n_pages"), F.regexp_count(html, F.lit("<meta")).alias("info_fields"), F.contains(html, F.lit("lang=")).alias("has_xmp"), F.regexp_count(html, F.lit("<script")).alias("n_embedded"))
    requests = scan.where("kind = 'text' and length(text) <= 12").select(F.col("page_id").alias("doc_id"), F.when(F.col("op_idx") % 7 == 0, 2).otherwise(1).alias("page_no"), F.col("box").alias("area"), F.col("text").alias("preview"))
    hidden = graphics.hidden_texts(scan, ["page_id"]).select(F.col("page_id").alias("doc_id"))
    images = scan.where("kind = 'image'").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page_no"), "box")
    return safety.safety_report(docs, requests, hidden, images).withColumn("warnings", F.array_join("warnings", "; "))


@register("c11_stripped_pages", f"WITH RECURSIVE {_SCAN}, cut AS (SELECT page_id, count(*) AS n FROM tagged WHERE NOT closes AND tag IN ('h1', 'br', 'article') GROUP BY 1) SELECT n.page_id, count(*) AS n_before, count(*) - 2 * coalesce(any_value(c.n), 0) AS n_left, count(*) FILTER (WHERE name = 'f') - coalesce(any_value(c.n), 0) AS fills_left FROM numbered n LEFT JOIN cut c USING (page_id) GROUP BY 1")
def stripped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators of every page before and after the fills that could hide text are stripped; white ones stay."""
    pages = markup.page_operators(table(spark, sf_dir, "pages").where("html is not null")).where(F.size("ops") > 0)
    left = graphics.without_covers(pages, ["page_id"]).select("page_id", F.size("ops").cast("long").alias("n_left"), F.size(F.filter("ops", lambda x: x["name"] == "f")).cast("long").alias("fills_left"))
    return pages.select("page_id", F.size("ops").cast("long").alias("n_before")).join(left, "page_id")


_OBJECTS = _TOKENS + """, open_ AS (SELECT page_id, piece_no, tag, level - 1 AS level FROM (SELECT *, sum(CASE WHEN closes THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY piece_no) AS level FROM tagged WHERE tag <> '') WHERE NOT closes),
objects AS (SELECT o.page_id, o.piece_no AS object_no, o.tag, o.level, p.piece_no AS parent_no FROM open_ o ASOF LEFT JOIN open_ p ON p.page_id = o.page_id AND p.level = o.level - 1 AND p.piece_no < o.piece_no)"""


@register("j15_object_graph", f"""WITH RECURSIVE {_OBJECTS}, links AS (SELECT page_id, parent_no AS source, object_no AS target FROM objects WHERE parent_no IS NOT NULL UNION ALL SELECT page_id, object_no, parent_no FROM objects WHERE parent_no IS NOT NULL),
reach AS (SELECT page_id, object_no AS node, 0 AS depth FROM objects WHERE parent_no IS NULL AND tag = 'html' UNION SELECT l.page_id, l.target, r.depth + 1 FROM reach r JOIN links l ON l.page_id = r.page_id AND l.source = r.node WHERE r.depth < 32)
SELECT page_id, CAST(node AS INTEGER) AS node, CAST(min(depth) AS INTEGER) AS depth FROM reach GROUP BY 1, 2""")
def object_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that one gets to from each page's root over references in both directions (so every page has cycles), with the fewest steps up to 32."""
    found = markup.objects(table(spark, sf_dir, "pages"))
    roots = found.where("parent_no is null and tag = 'html'").select("page_id", F.col("object_no").alias("node"))
    return graph.reachable(roots, markup.references(found), ["page_id"])


@register("c24_outline", f"""WITH RECURSIVE {_OBJECTS}, placed AS (SELECT *, row_number() OVER (PARTITION BY page_id, parent_no ORDER BY object_no) AS place FROM objects),
tree AS (SELECT page_id, object_no, tag, 0 AS depth, [place] AS path FROM placed WHERE parent_no IS NULL UNION ALL SELECT p.page_id, p.object_no, p.tag, t.depth + 1, list_append(t.path, p.place) FROM tree t JOIN placed p ON p.page_id = t.page_id AND p.parent_no = t.object_no WHERE t.depth < 32)
SELECT page_id, CAST(object_no AS INTEGER) AS object_no, tag, CAST(depth AS INTEGER) AS depth, array_to_string(path, '.') AS path FROM tree""")
def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's elements as a numbered outline of at most 33 levels."""
    items = markup.with_places(markup.objects(table(spark, sf_dir, "pages")))
    found = graph.outline(items.select("page_id", F.col("object_no").alias("node"), F.col("parent_no").alias("parent"), "place", "tag"), ["page_id"])
    return found.select("page_id", F.col("node").alias("object_no"), "tag", "depth", F.concat_ws(".", F.transform("path", lambda x: x.cast("string"))).alias("path"))
