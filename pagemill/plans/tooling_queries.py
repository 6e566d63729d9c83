"""Queries on baselines, requirement audits, manifests, ordering forms, several text sources and redaction results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import content, reports, tooling
from pagemill.operators.ranges import running
from pagemill.plans.registry import register
from pagemill.plans.report_queries import _SCAN, scan
from pagemill.session import table
from pagemill.sources import layout

_FILES = "files AS (SELECT doc_id AS file, text, list_distinct([lang, source, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END]) AS features FROM documents WHERE text IS NOT NULL)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select(F.col("doc_id").alias("file"), "text", F.array_distinct(F.array("lang", "source", F.when(F.col("n_chars") > 2000, "long").otherwise("short"))).alias("features"))


@register("k2_new_rows", "SELECT page_id, url FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)")
def new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that the labelled baseline does not know."""
    base = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"))
    return tooling.new_rows(table(spark, sf_dir, "pages").select("page_id", "url"), base, ["page_id"])


@register("k3_baseline", "SELECT event_type, user_id, round(min(value), 4) AS least, round(max(value), 4) AS most FROM events GROUP BY 1, 2")
def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each user and event type as a baseline holds them."""
    report = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    return tooling.rewritten_baseline(report, ["event_type", "user_id"], ["least", "most"])


_NEEDS = [("n1", "en", "core", 400), ("n2", "de", "core", None), ("n3", "long", "wide", None), ("n4", "xx", "none", None)]
_NEEDS_SQL = "needs AS (SELECT * FROM (VALUES ('n1', 'en', 'core', 400), ('n2', 'de', 'core', NULL), ('n3', 'long', 'wide', NULL), ('n4', 'xx', 'none', NULL)) AS t(requirement, feature, policy, minimum)), policy AS (SELECT * FROM (VALUES ('core', 50), ('wide', 200)) AS t(policy, policy_minimum))"


def _minimums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements with what they need and how many files have their feature."""
    needs = spark.createDataFrame(_NEEDS, "requirement string, feature string, policy string, minimum int")
    policy = spark.createDataFrame([("core", 50), ("wide", 200)], "policy string, policy_minimum int")
    counts = _files(spark, sf_dir).select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("files"))
    return tooling.with_minimum(needs, policy).join(counts, "feature", "left").withColumn("files", F.coalesce("files", F.lit(0).cast("long")))


@register("k6_minimums", f"WITH {_FILES}, {_NEEDS_SQL}, c AS (SELECT f AS feature, count(*) AS files FROM (SELECT unnest(features) AS f FROM files) GROUP BY 1) SELECT requirement, CAST(coalesce(minimum, policy_minimum, 1) AS INTEGER) AS needed_files, coalesce(files, 0) AS files, coalesce(files, 0) >= coalesce(minimum, policy_minimum, 1) AS met FROM needs LEFT JOIN policy USING (policy) LEFT JOIN c USING (feature)")
def minimums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minimums(spark, sf_dir).select("requirement", "needed_files", "files", (F.col("files") >= F.col("needed_files")).alias("met"))


#: (requirement, needed, mode, covers, min_atomic, min_corpus)
_POLICY = [("idiot", ["en"], "any", None, 2, None), ("r2", ["filter:license.text", "mail"], "all", ["of", "tion"], None, 1), ("zz3", ["xx", "image-color:nowhere:7"], "any", [], 1, None), ("zz4", ["de", "long"], "all", ["Heit.x"], None, 100), ("zz5", None, "any", ["dct:ab"], None, None)]
_POLICY_SQL = """policy AS (SELECT * FROM (VALUES ('idiot', ['en'], 'any', 2, NULL), ('r2', ['filter:license.text', 'mail'], 'all', NULL, 1), ('zz3', ['xx', 'image-color:nowhere:7'], 'any', 1, NULL), ('zz4', ['de', 'long'], 'all', NULL, 100), ('zz5', []::VARCHAR[], 'any', NULL, NULL)) AS t(requirement, needed, mode, min_atomic, min_corpus)),
tokens AS (SELECT * FROM (VALUES ('idiot', 'idiot'), ('idiot', 'en'), ('r2', 'r2'), ('r2', 'filter:license.text'), ('r2', 'license'), ('r2', 'mail'), ('r2', 'tion'), ('zz3', 'zz3'), ('zz3', 'xx'), ('zz3', 'image-color:nowhere:7'), ('zz3', 'nowhere'), ('zz4', 'zz4'), ('zz4', 'de'), ('zz4', 'long'), ('zz4', 'heit.x'), ('zz5', 'zz5'), ('zz5', 'dct:ab')) AS t(requirement, token)),
hits AS (SELECT DISTINCT requirement, file FROM tokens JOIN files ON contains(lower(text), token)),
evidence AS (SELECT requirement, file, nth FROM (SELECT *, row_number() OVER (PARTITION BY requirement ORDER BY file) AS nth FROM hits) WHERE nth <= 8)"""


def _policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_POLICY, "requirement string, needed array<string>, mode string, covers array<string>, min_atomic int, min_corpus int")


@register("k8_token_evidence", f"WITH {_FILES}, {_POLICY_SQL} SELECT requirement, file, CAST(nth AS INTEGER) AS nth FROM evidence")
def token_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight files with any token of each requirement (a top-k report)."""
    return tooling.token_evidence(tooling.evidence_tokens(_policy(spark)), _files(spark, sf_dir), 8)


@register("k7_coverage_status", f"""WITH {_FILES}, {_POLICY_SQL}, corpus AS (SELECT requirement, count(*) AS n FROM policy, files WHERE len(needed) > 0 AND CASE mode WHEN 'any' THEN len(list_intersect(needed, features)) > 0 ELSE len(list_intersect(needed, features)) = len(needed) END GROUP BY 1),
counts AS (SELECT p.requirement, (SELECT count(*) FROM evidence e WHERE e.requirement = p.requirement) AS atomic_count, coalesce(c.n, 0) AS corpus_count, coalesce(min_atomic, 1) AS ma, coalesce(min_corpus, 1) AS mc FROM policy p LEFT JOIN corpus c USING (requirement))
SELECT requirement, atomic_count, corpus_count, CASE WHEN atomic_count >= ma AND corpus_count >= mc THEN 'COVERED' WHEN atomic_count >= ma THEN 'MISSING_CORPUS' WHEN corpus_count >= mc THEN 'MISSING_ATOMIC' ELSE 'MISSING_BOTH' END AS status FROM counts""")
def coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each requirement's files in the corpus and among the tested texts, against its minimums."""
    policy, files = _policy(spark), _files(spark, sf_dir)
    return tooling.coverage_status(policy, tooling.token_evidence(tooling.evidence_tokens(policy), files, 8), reports.requirement_matches(files, policy.where("needed is not null")))


_STATE_SQL = f"""WITH {_SCAN}, g AS (SELECT source, lang, count(*) FILTER (WHERE result = 'FAIL') AS failing, count(*) FILTER (WHERE compared > 0) AS files, bool_or(status = 'PASS_ONE') AS unit, bool_and(n_chars < 9000) AS atomic FROM scan GROUP BY 1, 2),
states AS (SELECT source, lang, CASE WHEN failing > 0 THEN 'FAILING_RENDER' WHEN files = 0 THEN 'MISSING_CORPUS' WHEN NOT unit THEN 'MISSING_UNIT' WHEN NOT atomic THEN 'NOT_ATOMIC' ELSE 'COVERED' END AS state FROM g)"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = scan(spark, sf_dir).groupBy("source", "lang").agg(F.count_if(F.col("result") == "FAIL").alias("failing"), F.count_if(F.col("compared") > 0).alias("files"), F.bool_or(F.col("status") == "PASS_ONE").alias("unit"), F.bool_and(F.col("n_chars") < 9000).alias("atomic"))
    return groups.select("source", "lang", tooling.requirement_state(F.col("failing"), F.col("files"), F.col("unit"), F.col("atomic")).alias("state"))


@register("k9_requirement_states", _STATE_SQL + " SELECT state, count(*) AS n, count(*) FILTER (WHERE state IN ('FAILING_RENDER', 'MISSING_CORPUS')) AS hard_gate FROM states GROUP BY 1")
def requirement_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of all source and language pairs, and how many of them close the gate."""
    return _states(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"), F.count_if(F.col("state").isin("FAILING_RENDER", "MISSING_CORPUS")).alias("hard_gate"))


@register("k10_rows_with_token", "SELECT event_id, event_type FROM events WHERE contains(lower(event_type || '|' || coalesce(props, '') || '|' || user_id), 'click') OR contains(CAST(event_id AS VARCHAR), 'click')")
def rows_with_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that have a token anywhere in their serialised row."""
    return tooling.rows_with_token(table(spark, sf_dir, "events").select("event_id", "event_type", "props", "user_id"), "Click").select("event_id", "event_type")


@register("k11_group_counts", _STATE_SQL + " SELECT source, lang, state, count(*) AS n FROM states GROUP BY 1, 2, 3")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by area, profile and status, in order of these."""
    return _states(spark, sf_dir).groupBy("source", "lang", "state").agg(F.count("*").alias("n")).orderBy("source", "lang", "state")


@register("k14_manifest", f"WITH {_SCAN} SELECT DISTINCT path, CAST(CASE WHEN compared = 0 THEN 0 ELSE compared END AS INTEGER) AS page_no FROM scan WHERE status = 'PASS' AND list_has_any([lang, source], ['de', 'src1'])")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows of entries that are OK and have a feature."""
    entries = scan(spark, sf_dir).select("path", F.when(F.col("compared") > 0, F.col("compared")).alias("page_no"), F.when(F.col("status") == "PASS", "OK").otherwise(F.col("status")).alias("status"), F.array("lang", "source").alias("features"))
    return tooling.projected_manifest(entries, ["de", "src1"])


@register("k21_dangling_paths", """SELECT DISTINCT CAST(user_id AS VARCHAR) AS path FROM events WHERE user_id NOT IN (SELECT doc_id FROM labels)""")
def dangling_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths under a key at some depth of a JSON text that no table has."""
    nested = table(spark, sf_dir, "events").select(F.to_json(F.struct(F.struct(F.array(F.struct(F.concat(F.lit("user-"), "user_id").alias("file"), "event_type")).alias("items")).alias("body"))).alias("json"))
    known = table(spark, sf_dir, "labels").select(F.concat(F.lit("user-"), "doc_id").alias("path"))
    return tooling.dangling_paths(nested, "json", known).select(F.regexp_replace("path", "^user-", "").alias("path"))


@register("o4_all_phases", "SELECT event_type AS phase, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1")
def all_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All phases (n = 0) by total, count and name."""
    return tooling.top_phases(table(spark, sf_dir, "events").select(F.col("event_type").alias("phase"), F.floor("value").alias("ms")), 0)


@register("o4_top_phases", "SELECT event_type AS phase, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1 ORDER BY total DESC, n DESC, phase LIMIT 3")
def top_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest phases (a top-k report)."""
    return tooling.top_phases(table(spark, sf_dir, "events").select(F.col("event_type").alias("phase"), F.floor("value").alias("ms")), 3)


@register("o5_owned_first", "SELECT event_type AS phase, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total, event_type LIKE 'p%' AS owned, CAST(row_number() OVER (ORDER BY event_type LIKE 'p%' DESC, sum(CAST(floor(value) AS BIGINT)) DESC, event_type) AS INTEGER) AS place FROM events GROUP BY 1")
def owned_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases with owned scopes first and their place in that order."""
    from pyspark.sql import Window

    totals = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("phase")).agg(F.sum(F.floor("value")).alias("total"))
    ordered = tooling.owned_first(totals, F.col("phase").startswith("p"))
    return ordered.withColumn("place", F.row_number().over(Window.orderBy(F.desc("owned"), F.desc("total"), "phase")))  # one row a phase


@register("o13_split_mode", "SELECT doc_id, CAST(floor((doc_id % 10) / 4) AS INTEGER) AS part FROM documents")
def split_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the one split mode that is given."""
    mode = tooling.split_mode({"every": 4, "at": None, "bookmarks": None, "single": False})
    parts = {"every": F.floor((F.col("doc_id") % 10) / 4).cast("int")}
    return table(spark, sf_dir, "documents").select("doc_id", parts[mode].alias("part"))


@register("p19_expectations", """SELECT conv_id, turn, (CASE WHEN turn % 3 = 0 THEN '*' WHEN turn % 3 = 1 THEN 'user' ELSE 'assistant' END IN ('*', role)) AND (turn % 4 <> 0 OR coalesce(contains(text, 'the'), false) OR contains(role, 'the')) AS met FROM conversations""")
def expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each turn is what is expected of it, by role and by what it says."""
    turn = F.col("turn")
    expected = F.when(turn % 3 == 0, "*").when(turn % 3 == 1, "user").otherwise("assistant")
    met = tooling.expectation_met(expected, F.col("role"), F.when(turn % 4 == 0, "the"), F.col("text"), F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", met.alias("met"))


@register("p17_visible_letters", """WITH l AS (SELECT doc_id, lang, unnest(range(1, length(text) + 1)) AS i FROM documents WHERE text IS NOT NULL) SELECT doc_id, count(*) AS n FROM l WHERE i % 7 <> 0 GROUP BY doc_id""")
def visible_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of each document that are in no hidden layer; every seventh is in one."""
    docs = table(spark, sf_dir, "documents").where("length(text) > 0")
    letters = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("i")).withColumn("hidden_layer", F.when(F.col("i") % 7 == 0, F.lit(True)))
    return tooling.visible(letters).groupBy("doc_id").agg(F.count("*").alias("n"))


_FIELDS = "fields AS (SELECT conv_id AS doc_id, turn AS ordinal, CASE role WHEN 'user' THEN 'text' ELSE 'choice' END AS kind, role || '.' || (turn % 3) AS full_name, text AS value FROM conversations)"


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), F.when(F.col("role") == "user", "text").otherwise("choice").alias("kind"), F.concat("role", F.lit("."), (F.col("turn") % 3).cast("string")).alias("full_name"), F.col("text").alias("value"))


@register("p15_find_field", f"WITH {_FIELDS} SELECT doc_id, ordinal, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS n FROM fields WHERE kind = 'text' AND full_name = 'user.0') WHERE n = 1")
def field_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each form the first text field with a full name."""
    return tooling.find_field(tooling.fields_of(_fields(spark, sf_dir), "text"), "user.0")


_LINES_OPS = """lines AS (SELECT doc_id, CAST(floor(line_no / 60) + 1 AS INTEGER) AS page_no, line_no % 60 AS row, text FROM (SELECT doc_id, unnest(ts) AS text, CAST(unnest(range(len(ts))) AS INTEGER) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS ts FROM documents WHERE text IS NOT NULL)) WHERE length(text) > 0),
ops AS (SELECT doc_id, page_no, row * 5 + k AS op_idx, ['BT', 'Tf', 'Td', 'Tj', 'ET'][k + 1] AS name, CASE WHEN k = 3 THEN text END AS text, row FROM (SELECT *, unnest(range(5)) AS k FROM lines))"""


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.layout_operators(table(spark, sf_dir, "documents"))


@register("p5_transform", f"WITH {_LINES_OPS} SELECT doc_id, page_no, CAST(op_idx AS INTEGER) AS op_idx, CASE WHEN name = 'Tj' THEN 'TJ' ELSE name END AS name, '(' || text || ')' AS text FROM ops")
def transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every operator mapped: shown text in brackets by another operator."""
    name = F.when(F.col("name") == "Tj", "TJ").otherwise(F.col("name"))
    return tooling.transformed(_ops(spark, sf_dir), {"name": name, "text": F.concat(F.lit("("), "text", F.lit(")"))}).select("doc_id", "page_no", F.col("op_idx").cast("int").alias("op_idx"), "name", "text")


@register("p6_positional_edits", f"WITH {_LINES_OPS}, p AS (SELECT DISTINCT doc_id, page_no FROM ops) SELECT doc_id, page_no, CAST(CASE WHEN op_idx >= 5 THEN op_idx + 2 ELSE op_idx END AS INTEGER) AS op_idx, CASE WHEN op_idx = 0 THEN 'BDC' ELSE name END AS name FROM ops UNION ALL SELECT doc_id, page_no, 5, 'q' FROM p UNION ALL SELECT doc_id, page_no, 6, 'Q' FROM p")
def positional_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two operators inserted before place 5 and place 0 replaced on every page."""
    ops = _ops(spark, sf_dir).select("doc_id", "page_no", F.col("op_idx").cast("int").alias("op_idx"), "name", "text")
    new = ops.select("doc_id", "page_no").distinct().select("doc_id", "page_no", F.posexplode(F.array(F.lit("q"), F.lit("Q"))).alias("nth", "name"))
    return tooling.replaced(tooling.inserted(ops, 5, new), 0, F.lit("BDC"), F.lit(None)).select("doc_id", "page_no", "op_idx", "name")


_ACTS = f"WITH {_LINES_OPS}, acts AS (SELECT *, CASE WHEN name = 'Tj' AND row < 3 THEN 'area' WHEN contains(text, 'the') THEN 'text' WHEN name = 'ET' THEN 'category' END AS action FROM ops)"


def _acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = F.col("box").isNotNull() & (F.col("box")["t"] > 700)
    return tooling.apply_actions(_ops(spark, sf_dir), [("area", area), ("text", F.coalesce(F.contains("text", F.lit("the")), F.lit(False))), ("category", F.col("name") == "ET")])


@register("c7_redaction_actions", _ACTS + " SELECT coalesce(action, 'kept') AS action, count(*) AS n FROM acts GROUP BY 1")
def redaction_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered list of actions applied at once: which action takes each operator."""
    return _acts(spark, sf_dir).groupBy(F.coalesce("action", F.lit("kept")).alias("action")).agg(F.count("*").alias("n"))


@register("a22_redaction_counters", _ACTS + " SELECT doc_id, count(action) AS operators_removed, CAST(coalesce(sum(CASE WHEN action IS NOT NULL THEN length(text) END), 0) AS BIGINT) AS letters_removed, CAST(count(DISTINCT CASE WHEN action IS NULL THEN NULL WHEN name = 'Tj' THEN 'show' ELSE 'object' END) AS INTEGER) AS categories FROM acts GROUP BY 1")
def redaction_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the actions removed from each document."""
    return tooling.action_counts(_acts(spark, sf_dir), ["doc_id"])


@register("c9_area_redaction", f"WITH {_LINES_OPS} SELECT doc_id, page_no, row AS line_row, substr(text, 1, 5) || substr(text, 16) AS text FROM ops WHERE name = 'Tj' AND row BETWEEN 2 AND 4 UNION ALL SELECT doc_id, page_no, row, text FROM ops WHERE name = 'Tj' AND row NOT BETWEEN 2 AND 4")
def area_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each line when the letters of an area go."""
    from pagemill.functions import geometry as G

    area = G.rect(F.lit(103.0), F.lit(673.0), F.lit(160.0), F.lit(705.0))
    lines = layout.line_letters(table(spark, sf_dir, "documents")).where(F.size("letters") > 0)
    kept = F.filter("letters", lambda x: ~G.removed(x["box"], area, "AnyOverlap"))
    return lines.select("doc_id", "page_no", F.col("row").alias("line_row"), F.array_join(F.transform(kept, lambda x: x["value"]), "").alias("text"))


@register("c11_obstructions", f"WITH {_LINES_OPS} SELECT doc_id, page_no, count(*) AS n FROM ops WHERE NOT (name = 'Tj' AND length(text) * 60 >= 3000) GROUP BY 1, 2")
def obstructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators of each page without the opaque fills; each line's box is taken for a fill here."""
    fills = _ops(spark, sf_dir).withColumn("name", F.when(F.col("name") == "Tj", "f").otherwise(F.col("name")))
    return tooling.without_obstructions(fills, 3000.0).groupBy("doc_id", "page_no").agg(F.count("*").alias("n"))


def _sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    turns = table(spark, sf_dir, "conversations")
    pick = lambda rows: rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")
    return {"page": layout.pages(table(spark, sf_dir, "documents").where("text is not null")), "annotation": pick(turns.where("role = 'user'")), "form value": pick(turns.where("role <> 'user'"))}


@register("c4_sources_search", """WITH pages_ AS (SELECT doc_id, CAST(floor(line_no / 60) + 1 AS INTEGER) AS page_no, string_agg(text, chr(10) ORDER BY line_no) AS text FROM (SELECT doc_id, unnest(ts) AS text, CAST(unnest(range(len(ts))) AS INTEGER) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS ts FROM documents WHERE text IS NOT NULL)) GROUP BY 1, 2)
SELECT source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS letters FROM (SELECT doc_id, page_no, text, 'page' AS source FROM pages_ WHERE contains(lower(text), 'ation') UNION ALL SELECT conv_id, turn, '[in annotation] ' || text, 'annotation' FROM conversations WHERE role = 'user' AND contains(lower(text), 'ation') UNION ALL SELECT conv_id, turn, '[in form value] ' || text, 'form value' FROM conversations WHERE role <> 'user' AND contains(lower(text), 'ation')) GROUP BY 1""")
def sources_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches in page text, annotations and form values."""
    return tooling.search_sources(_sources(spark, sf_dir), "ATION").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("letters"))


@register("c5_indexed_search", """WITH w AS (SELECT doc_id, unnest(list_distinct(string_split_regex(lower(text), '[^\\pL\\pN_]+'))) AS word FROM documents WHERE text IS NOT NULL) SELECT word, count(*) AS docs, min(doc_id) AS first_doc FROM w WHERE word IN ('the', 'license', 'idiot', 'heit', 'nowhere') GROUP BY 1""")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several words looked up in a word index of all documents."""
    index = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"))).alias("word"))
    asked = spark.createDataFrame([(w,) for w in ("the", "license", "idiot", "heit", "nowhere")], "word string")
    return index.join(asked, "word").groupBy("word").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


@register("a23_searchable_totals", "SELECT lang, count(*) AS n, count(*) FILTER (WHERE text IS NULL OR text = '') AS skipped, count(*) FILTER (WHERE length(text) > 0) AS written, CAST(coalesce(sum(length(regexp_replace(text, '[\\x00-\\xFF]', '', 'g'))), 0) AS BIGINT) AS unencodable FROM documents GROUP BY 1")
def searchable_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed, skipped and written documents, and letters that one byte cannot hold."""
    odd = F.length(F.regexp_replace("text", r"[\x00-\xFF]", ""))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("skipped"), F.count_if(F.length("text") > 0).alias("written"), F.coalesce(F.sum(odd), F.lit(0)).alias("unencodable"))


@register("f13_file_names", "SELECT doc_id, source || '_REDACTED' || CASE WHEN n > 1 AND n - 1 <= 999 THEN '_' || (n - 1) ELSE '' END || '.pdf' AS suggested FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents)")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggested names of redacted copies, numbered where they meet."""
    docs = running(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["source", "lang"], ["doc_id"]).select("doc_id", F.concat("source", F.lit(".pdf")).alias("name"), (F.col("nth") - 1).alias("n"))
    return docs.select("doc_id", tooling.suggested_name(F.col("name"), "_REDACTED", F.col("n")).alias("suggested"))


@register("f21_image_metrics", """SELECT l_returnflag, round(avg(CASE WHEN abs(a - b) > 10 THEN 1.0 ELSE 0.0 END), 6) AS diff_fraction, round(avg(abs(a - b)), 6) AS mae, max(abs(a - b)) AS max_difference, round(sqrt(avg((a - b) * (a - b))), 6) AS rmse,
  round((2 * avg(a) * avg(b) + 6.5025) * (2 * covar_samp(a, b) + 58.5225) / ((avg(a) * avg(a) + avg(b) * avg(b) + 6.5025) * (var_samp(a) + var_samp(b) + 58.5225)), 6) AS ssim
FROM (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS a, CAST(l_linenumber * 7 AS DOUBLE) AS b FROM lineitem) GROUP BY 1""")
def image_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference metrics of two series of samples in each group."""
    pairs = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("a"), (F.col("l_linenumber") * 7).cast("double").alias("b"))
    found = tooling.pixel_metrics(pairs, ["l_returnflag"], "a", "b", 10)
    return found.select("l_returnflag", "max_difference", *(F.round(c, 6).alias(c) for c in ("diff_fraction", "mae", "rmse", "ssim")))


@register("f23_dates", "SELECT event_id, ts AS parsed FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in the page format, read back."""
    text = F.concat(F.lit("D:"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("+00'00'"))
    return table(spark, sf_dir, "events").select("event_id", tooling.parsed_date(text).cast("timestamp_ntz").alias("parsed"))


@register("f2_letter_folds", "SELECT doc_id, CAST(length(text) AS INTEGER) AS n, CAST(length(nfc_normalize(replace(replace(replace(replace(replace(replace(text, chr(160), ' '), chr(173), ''), chr(8203), ''), chr(8204), ''), chr(8205), ''), chr(65279), ''))) AS INTEGER) AS n_folded FROM documents")
def letter_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of each text, and characters of its letters' matching forms."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", T.folded_with_places(F.col("text")).alias("f"))
    return docs.select("doc_id", F.length("text").alias("n"), F.length(F.coalesce("f.folded", "text")).alias("n_folded"))


@register("s14_csv_rows", f"WITH {_SCAN} SELECT '\"' || path || '\",' || status || ',' || CASE WHEN render_ms < 0 THEN '' ELSE CAST(CAST(render_ms AS BIGINT) AS VARCHAR) END AS line FROM scan")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a page report as CSV: quoted paths, whole numbers without a point, nothing where nothing was measured."""
    ms = F.coalesce(reports.measured(F.col("render_ms")).cast("long").cast("string"), F.lit(""))
    return scan(spark, sf_dir).select(F.concat(T.csv_quote(F.col("path")), F.lit(","), "status", F.lit(","), ms).alias("line"))
