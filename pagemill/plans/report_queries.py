"""Queries on corpus reports, lookups, baselines, manifests and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import reports as R
from pagemill.operators.ranges import running
from pagemill.plans.registry import register
from pagemill.session import table

#: A scan report derived from documents: one entry each, with statuses, measurements (negative: not measured) and renderer scores.
_SCAN = """scan AS (SELECT doc_id, source, lang, n_chars,
  CASE doc_id % 3 WHEN 0 THEN 'f' || doc_id WHEN 1 THEN 'pdfjs/f' || doc_id ELSE 'other/f' || doc_id END AS path,
  CASE WHEN doc_id % 13 = 0 THEN 'DIFF' WHEN doc_id % 11 = 0 THEN 'PASS_ONE' WHEN doc_id % 29 = 0 THEN 'MALFORMED_PDF' WHEN doc_id % 31 = 0 THEN 'OTHER' ELSE 'PASS' END AS status,
  CASE WHEN doc_id % 13 = 0 THEN 'FAIL' ELSE 'PASS' END AS result,
  CAST(n_chars % 997 AS DOUBLE) AS elapsed_ms, CAST(CASE WHEN doc_id % 10 = 0 THEN -1 ELSE n_chars % 499 END AS DOUBLE) AS render_ms, CAST(CASE WHEN doc_id % 6 = 0 THEN -1 ELSE n_chars % 211 END AS DOUBLE) AS extract_ms,
  (n_chars % 101) / 100.0 AS own, (n_chars % 97) / 100.0 AS r1, (n_chars % 89) / 100.0 AS r2, (n_chars % 83) / 100.0 AS r3, CAST(doc_id % 5 AS INTEGER) AS compared, CAST(doc_id % 4 AS INTEGER) AS disagreeing FROM documents)"""


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan report as a DataFrame; see _SCAN."""
    i, n = F.col("doc_id"), F.col("n_chars")
    name = F.concat(F.lit("f"), i.cast("string"))
    path = F.when(i % 3 == 0, name).when(i % 3 == 1, F.concat(F.lit("pdfjs/"), name)).otherwise(F.concat(F.lit("other/"), name))
    status = F.when(i % 13 == 0, "DIFF").when(i % 11 == 0, "PASS_ONE").when(i % 29 == 0, "MALFORMED_PDF").when(i % 31 == 0, "OTHER").otherwise("PASS")
    score = {name: ((n % m) / 100.0).alias(name) for name, m in (("own", 101), ("r1", 97), ("r2", 89), ("r3", 83))}
    return table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", "n_chars", path.alias("path"), status.alias("status"), F.when(i % 13 == 0, "FAIL").otherwise("PASS").alias("result"), (n % 997).cast("double").alias("elapsed_ms"),
        F.when(i % 10 == 0, -1).otherwise(n % 499).cast("double").alias("render_ms"), F.when(i % 6 == 0, -1).otherwise(n % 211).cast("double").alias("extract_ms"), *score.values(), (i % 5).cast("int").alias("compared"), (i % 4).cast("int").alias("disagreeing"))


@register("a1_count_by", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def count_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts_by(table(spark, sf_dir, "documents"), F.col("lang"), "lang")


@register("a2_null_bucket", "SELECT coalesce(CAST(l.quality AS VARCHAR), 'unclassified') AS quality, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def null_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return R.counts_by(joined, R.blank_as(F.col("quality").cast("string"), "unclassified"), "quality")


@register("a3_status_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts_by(table(spark, sf_dir, "events"), F.col("event_type"), "event_type")


@register("a4_conditional_counts", f"WITH {_SCAN} SELECT source, count(*) AS n, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE result = 'FAIL') AS failed, count(*) FILTER (WHERE render_ms < 0) AS unmeasured FROM scan GROUP BY source")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("result") == "FAIL").alias("failed"), F.count_if(F.col("render_ms") < 0).alias("unmeasured"))


@register("a5_distinct_counts", "SELECT count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, count(DISTINCT text) AS texts, count(*) AS n FROM documents")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"), F.countDistinct(F.sha2("text", 256)).alias("texts"), F.count("*").alias("n"))


@register("a6_average", f"WITH {_SCAN} SELECT source, coalesce(round(avg(CASE WHEN render_ms >= 0 THEN render_ms END), 6), 0.0) AS render, coalesce(round(avg(CASE WHEN status = 'OTHER' THEN elapsed_ms END), 6), 0.0) AS other FROM scan GROUP BY source")
def averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir).groupBy("source").agg(R.average(R.measured(F.col("render_ms"))).alias("render"), R.average(F.when(F.col("status") == "OTHER", F.col("elapsed_ms"))).alias("other"))


@register("a7_percentiles", "SELECT event_type, CAST(quantile_disc(value, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(value, 0.95) AS DOUBLE) AS p95, CAST(quantile_disc(value, 0.99) AS DOUBLE) AS p99 FROM events GROUP BY 1")
def percentile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@register("a8_totals", "SELECT event_type, round(sum(value), 2) AS total, min(value) AS least, max(value) AS most, count(*) AS n FROM events GROUP BY 1")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum("value"), 2).alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n"))


@register("a9_ratio", f"WITH {_SCAN} SELECT source, round(count(*) FILTER (WHERE status = 'PASS') / CAST(count(*) AS DOUBLE), 6) AS pass_rate, round(count(*) FILTER (WHERE status = 'PASS_ONE') / CAST(nullif(count(*) FILTER (WHERE status = 'OTHER'), 0) AS DOUBLE), 6) AS odd FROM scan GROUP BY source")
def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return scan(spark, sf_dir).groupBy("source").agg(R.ratio(n("PASS"), F.count("*")).alias("pass_rate"), R.ratio(n("PASS_ONE"), n("OTHER")).alias("odd"))


@register("a11_first_per_group", "SELECT user_id, arg_min(value, event_id) AS first_value, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("value", "event_id").alias("first_value"), F.max_by("event_type", "event_id").alias("last_type"))


_PHASES = _SCAN + """, phases AS (SELECT source, 'render' AS phase, render_ms AS ms FROM scan WHERE render_ms >= 0 UNION ALL SELECT source, 'extract', extract_ms FROM scan WHERE extract_ms >= 0
  UNION ALL SELECT source, 'overhead', greatest(0.0, elapsed_ms - greatest(render_ms, 0) - greatest(extract_ms, 0)) FROM scan)"""


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, phase, ms): measured phases and the overhead that they leave of the elapsed time."""
    over = F.greatest(F.lit(0.0), F.col("elapsed_ms") - F.greatest("render_ms", F.lit(0.0)) - F.greatest("extract_ms", F.lit(0.0)))
    named = scan(spark, sf_dir).select("source", F.col("render_ms").alias("render"), F.col("extract_ms").alias("extract"), over.alias("overhead"))
    return R.unpivoted(named, ["source"], ["render", "extract", "overhead"], "phase", "ms")


@register("a12_phases", f"WITH {_PHASES} SELECT source, phase, count(*) AS n, sum(ms) AS total, max(ms) AS most FROM phases GROUP BY 1, 2")
def phase_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phases(spark, sf_dir).groupBy("source", "phase").agg(F.count("*").alias("n"), F.sum("ms").alias("total"), F.max("ms").alias("most"))


@register("a13_share", f"WITH {_PHASES} SELECT phase, sum(ms) AS total, round(sum(ms) / sum(sum(ms)) OVER (), 6) AS share FROM phases GROUP BY 1")
def phase_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_share(phases(spark, sf_dir).groupBy("phase").agg(F.sum("ms").alias("total")), "total")


@register("a14_clusters", f"""WITH {_SCAN}, r AS (SELECT source, status, CAST(compared AS VARCHAR) AS compared, path, row_number() OVER (PARTITION BY source, status, compared ORDER BY path) AS n FROM scan)
SELECT source, status, compared, count(*) AS n, string_agg(CASE WHEN n <= 12 THEN path END, ',' ORDER BY path) AS members FROM r GROUP BY 1, 2, 3""")
def cluster_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.clusters(scan(spark, sf_dir), ["source", "status", "compared"], F.col("path"))


@register("a15_blast_radius", "SELECT t AS feature, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS t FROM documents) GROUP BY 1")
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each word occurs."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("feature"))
    return words.groupBy("feature").agg(F.count("*").alias("docs"))


_PAIRS = _SCAN + """, m AS (SELECT doc_id, 1 AS k, r1 AS v FROM scan UNION ALL SELECT doc_id, 2, r2 FROM scan UNION ALL SELECT doc_id, 3, r3 FROM scan),
pairs AS (SELECT a.doc_id, a.k AS first, b.k AS second, abs(a.v - b.v) AS difference FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.k < b.k)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = scan(spark, sf_dir).select("doc_id", F.posexplode(F.array("r1", "r2", "r3")).alias("k", "v"))
    return R.pairs_in_group(values.withColumn("k", F.col("k") + 1), ["doc_id"], "k", "v")


@register("j10_renderer_pairs", f"WITH {_PAIRS} SELECT doc_id, first, second, round(difference, 6) AS difference FROM pairs")
def renderer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("difference", F.round("difference", 6))


@register("a20_pair_summary", f"""WITH {_PAIRS}, s AS (SELECT doc_id, count(*) AS pairs, count(*) FILTER (WHERE difference > 0.3) AS disagreeing, round(avg(difference), 6) AS mean, round(max(difference), 6) AS most FROM pairs GROUP BY 1)
SELECT *, CASE WHEN pairs = 0 THEN 'unmeasured' WHEN disagreeing = 0 THEN 'none' WHEN disagreeing = pairs THEN 'all' ELSE 'some' END AS bucket FROM s""")
def pair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _pairs(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("difference") > 0.3).alias("disagreeing"), F.round(F.avg("difference"), 6).alias("mean"), F.round(F.max("difference"), 6).alias("most"))
    return found.withColumn("bucket", R.disagreement(F.col("disagreeing"), F.col("pairs")))


@register("a24_gate", f"WITH {_SCAN} SELECT source, bool_and(status <> 'DIFF' OR own < 0.9) AS passed, avg(CASE WHEN status = 'PASS' THEN 1.0 ELSE 0.0 END) >= 0.6 AS rate_ok FROM scan GROUP BY source")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir).groupBy("source").agg(F.bool_and((F.col("status") != "DIFF") | (F.col("own") < 0.9)).alias("passed"), (F.avg((F.col("status") == "PASS").cast("double")) >= 0.6).alias("rate_ok"))


@register("a24_checks", f"""WITH {_SCAN}, m AS (SELECT source, avg(elapsed_ms) AS elapsed, avg(CASE WHEN render_ms >= 0 THEN render_ms END) AS render, avg(CASE WHEN status = 'PASS' THEN 1.0 ELSE 0.0 END) AS rate, avg(CASE WHEN status = 'PASS_ONE' THEN r1 END) AS one FROM scan GROUP BY 1),
c AS (SELECT source, 'elapsed-average' AS "check", elapsed AS actual, 490.0 AS threshold, 'ms' AS unit, elapsed <= 490 AS passed FROM m UNION ALL SELECT source, 'render-average', render, 240.0, 'ms', render <= 240 FROM m UNION ALL SELECT source, 'pass-rate', rate, 0.8, 'ratio', rate >= 0.8 FROM m UNION ALL SELECT source, 'one-reference', one, 0.4, 'ratio', one >= 0.4 FROM m)
SELECT source, "check", round(actual, 6) AS actual, threshold, unit, passed, bool_and(passed) OVER (PARTITION BY source) AS gate_passed FROM c WHERE actual IS NOT NULL""")
def gate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of each source's gate; a check whose measure was not taken is left out."""
    status = F.col("status")
    measures = scan(spark, sf_dir).groupBy("source").agg(F.avg("elapsed_ms").alias("elapsed"), F.avg(R.measured(F.col("render_ms"))).alias("render"), F.avg((status == "PASS").cast("double")).alias("rate"), F.avg(F.when(status == "PASS_ONE", F.col("r1"))).alias("one"))
    checks = [("elapsed-average", "elapsed", 490.0, "most", "ms"), ("render-average", "render", 240.0, "most", "ms"), ("pass-rate", "rate", 0.8, "least", "ratio"), ("one-reference", "one", 0.4, "least", "ratio")]
    return R.gate(measures, ["source"], checks).withColumn("actual", F.round("actual", 6))


_CONTRACTS = "contracts AS (SELECT DISTINCT 'f' || doc_id AS path, CASE WHEN toxic = 1 THEN 'NEEDS_REVIEW' WHEN quality = 0 THEN '' ELSE 'PASS' END AS expected FROM labels)"


def _contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = F.when(F.col("toxic") == 1, "NEEDS_REVIEW").when(F.col("quality") == 0, "").otherwise("PASS")
    return table(spark, sf_dir, "labels").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), expected.alias("expected")).distinct()


@register("j1_contract_lookup", f"WITH {_SCAN}, {_CONTRACTS} SELECT s.path, coalesce(nullif(trim(c.expected), ''), CASE WHEN c.path IS NULL THEN 'MISSING' ELSE s.status END) AS expected FROM scan s LEFT JOIN contracts c ON c.path = 'f' || s.doc_id")
def contract_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _contracts(spark, sf_dir).withColumnRenamed("path", "key").withColumn("hit", F.lit(True))
    joined = scan(spark, sf_dir).withColumn("key", F.concat(F.lit("f"), F.col("doc_id").cast("string"))).join(known, "key", "left")
    return joined.select("path", F.coalesce(F.nullif(F.trim("expected"), F.lit("")), F.when(F.col("hit").isNull(), "MISSING").otherwise(F.col("status"))).alias("expected"))


@register("j2_fallback_lookup", f"""WITH {_SCAN}, known AS (SELECT path || '' AS path, expected FROM (SELECT DISTINCT CASE doc_id % 2 WHEN 0 THEN 'f' || doc_id ELSE 'pdfjs/f' || doc_id END AS path, CASE WHEN toxic = 1 THEN 'T' ELSE 'C' END AS expected FROM labels))
SELECT s.path, coalesce(a.expected, b.expected, c.expected) AS expected FROM scan s LEFT JOIN known a ON a.path = s.path LEFT JOIN known b ON NOT contains(s.path, '/') AND b.path = 'pdfjs/' || s.path LEFT JOIN known c ON starts_with(s.path, 'pdfjs/') AND c.path = substr(s.path, 7)""")
def fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    name = F.concat(F.lit("f"), i.cast("string"))
    known = table(spark, sf_dir, "labels").select(F.when(i % 2 == 0, name).otherwise(F.concat(F.lit("pdfjs/"), name)).alias("path"), F.when(F.col("toxic") == 1, "T").otherwise("C").alias("expected")).distinct()
    return R.looked_up(scan(spark, sf_dir).select("path"), known, "expected", "pdfjs/")


@register("j4_manifest_pages", f"WITH {_SCAN}, {_CONTRACTS} SELECT doc_id, path FROM scan WHERE 'f' || doc_id IN (SELECT path FROM contracts)")
def manifest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _contracts(spark, sf_dir).select(F.col("path").alias("key"))
    return scan(spark, sf_dir).withColumn("key", F.concat(F.lit("f"), F.col("doc_id").cast("string"))).join(keys, "key", "left_semi").select("doc_id", "path")


@register("j14_dimension_default", """SELECT e.event_id, coalesce(d.owner, 'unknown') AS owner FROM events e LEFT JOIN (VALUES ('click', 'input'), ('view', 'render'), ('error', 'runtime')) AS d(event_type, owner) USING (event_type)""")
def dimension_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = spark.createDataFrame([("click", "input"), ("view", "render"), ("error", "runtime")], "event_type string, owner string")
    return table(spark, sf_dir, "events").join(F.broadcast(owners), "event_type", "left").select("event_id", F.coalesce("owner", F.lit("unknown")).alias("owner"))


@register("w4_rank", f"WITH {_SCAN} SELECT doc_id, CAST(1 + CAST(r1 < own AS INTEGER) + CAST(r2 < own AS INTEGER) + CAST(r3 < own AS INTEGER) AS INTEGER) AS rank FROM scan")
def centre_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's own score among the renderers': 1 and one more for each lower one."""
    return scan(spark, sf_dir).select("doc_id", (1 + sum((F.col(r) < F.col("own")).cast("int") for r in ("r1", "r2", "r3"))).cast("int").alias("rank"))


@register("w5_best", f"WITH {_SCAN} SELECT doc_id, CASE WHEN r1 <= r2 AND r1 <= r3 THEN 'r1' WHEN r2 <= r3 THEN 'r2' ELSE 'r3' END AS best FROM scan")
def best_renderer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The renderer with the least score; ties go to the first."""
    return scan(spark, sf_dir).select("doc_id", F.array_min(F.array(*(F.struct(F.col(r).alias("v"), F.lit(r).alias("name")) for r in ("r1", "r2", "r3"))))["name"].alias("best"))


@register("o3_priority", f"WITH {_SCAN} SELECT path, status, CAST(own * 100 AS INTEGER) AS impact FROM scan ORDER BY CASE WHEN status = 'DIFF' THEN 0 WHEN status = 'PASS_ONE' THEN 1 ELSE 2 END, own DESC, path LIMIT 50")
def priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty entries to look at first."""
    rank = F.when(F.col("status") == "DIFF", 0).when(F.col("status") == "PASS_ONE", 1).otherwise(2)
    return scan(spark, sf_dir).orderBy(rank, F.desc("own"), "path").limit(50).select("path", "status", F.round(F.col("own") * 100).cast("int").alias("impact"))


@register("o6_worklist", f"WITH {_SCAN} SELECT path, least(own, r1) AS score FROM scan WHERE least(own, r1) < 0.2")
def worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir).select("path", F.least("own", "r1").alias("score")).where("score < 0.2").orderBy("score", "path")


@register("c21_quality_inference", f"""WITH {_SCAN} SELECT path,
CASE status WHEN 'PASS' THEN 'PIXEL_EXACT' WHEN 'PASS_ONE' THEN 'MATCHES_ACCEPTED_REFERENCE' WHEN 'MALFORMED_PDF' THEN 'NON_RENDERABLE_ACCEPTED' WHEN 'DIFF' THEN 'FAIL' ELSE CASE WHEN result = 'PASS' THEN 'GOOD_ENOUGH' ELSE 'FAIL' END END AS quality,
CASE WHEN compared = 0 THEN 'REFS_INCOMPLETE' WHEN disagreeing > 0 THEN 'REFS_DISAGREE' ELSE 'REFS_AGREE' END AS situation, CASE status WHEN 'DIFF' THEN 'P1' WHEN 'PASS_ONE' THEN 'P2' ELSE 'NONE' END AS priority,
CASE WHEN status = 'PASS' THEN 'HIGH' WHEN status = 'PASS_ONE' AND compared < 3 THEN 'LOW' ELSE 'MEDIUM' END AS confidence FROM scan""")
def quality_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("status")
    return scan(spark, sf_dir).select("path", R.quality_status(status, F.col("result"), F.lit(True)).alias("quality"), R.reference_situation(status, F.col("compared"), F.col("disagreeing")).alias("situation"), R.improvement_priority(status).alias("priority"), R.confidence(status, F.col("compared")).alias("confidence"))


_REVIEW = _SCAN + """, r AS (SELECT *, compared - disagreeing AS agreeing, CASE WHEN doc_id % 2 = 0 THEN 'r1' ELSE 'r2' END AS best, CASE WHEN doc_id % 4 <> 3 THEN 'r1' END AS target, doc_id % 5 <> 0 AS has_contract,
  CASE doc_id % 3 WHEN 0 THEN 'REVIEWED' WHEN 1 THEN 'GENERATED' ELSE '' END AS review, CASE WHEN n_chars % 2 = 0 THEN 'known' END AS reason, CASE WHEN doc_id % 17 = 0 THEN 'BLOCKED' ELSE ' ' END AS override, doc_id % 4 AS rank FROM scan),
o AS (SELECT *, compared >= 3 AND ((agreeing = 1 AND compared > 0 AND disagreeing = 0) OR (agreeing <= 1 AND rank >= 3)) AS outlier FROM r),
v AS (SELECT *, CASE WHEN status <> 'PASS_ONE' THEN 'N/A' WHEN result = 'FAIL' THEN 'rejected' WHEN NOT has_contract THEN 'unreviewed' WHEN review = 'REVIEWED' THEN 'accepted' WHEN review IN ('GENERATED', 'NEEDS_REVIEW') OR outlier OR coalesce(target, '') = '' OR coalesce(reason, '') = '' THEN 'unreviewed' ELSE 'accepted' END AS pass_one FROM o)"""


@register("c21_review", f"""WITH {_REVIEW} SELECT path, outlier, pass_one, CASE WHEN trim(override) <> '' THEN override WHEN status = 'PASS_ONE' AND pass_one = 'unreviewed' THEN 'NEEDS_REVIEW' ELSE 'PASS' END AS release,
  CASE status WHEN 'PASS' THEN 'MATCHES_ALL_REQUIRED' WHEN 'PASS_ONE' THEN CASE WHEN best = target THEN 'MATCHES_TARGET' WHEN agreeing = 1 THEN 'MATCHES_ONE_REFERENCE' ELSE 'MATCHES_SOME' END WHEN 'DIFF' THEN 'MATCHES_NONE' ELSE 'NOT_COMPARABLE' END AS agreement,
  CASE status WHEN 'MALFORMED_PDF' THEN 'MALFORMED_INPUT_POLICY' WHEN 'PASS_ONE' THEN 'REFERENCE_DISAGREEMENT' ELSE 'REFERENCE_CONSENSUS' END AS basis FROM v""")
def review_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is inferred of each page besides its quality: agreement, basis, outlier, review and release status."""
    i, status = F.col("doc_id"), F.col("status")
    rows = scan(spark, sf_dir).select("*", (F.col("compared") - F.col("disagreeing")).alias("agreeing"), F.when(i % 2 == 0, "r1").otherwise("r2").alias("best"), F.when(i % 4 != 3, "r1").alias("target"), (i % 5 != 0).alias("has_contract"), F.when(i % 3 == 0, "REVIEWED").when(i % 3 == 1, "GENERATED").otherwise("").alias("review"), F.when(F.col("n_chars") % 2 == 0, "known").alias("reason"), F.when(i % 17 == 0, "BLOCKED").otherwise(" ").alias("override"))
    rows = rows.withColumn("outlier", R.outlier(F.col("compared"), F.col("agreeing"), F.col("compared"), F.col("disagreeing"), i % 4))
    rows = rows.withColumn("pass_one", R.pass_one_review(status, F.col("result"), F.col("has_contract"), F.col("review"), F.col("outlier"), F.col("target"), F.col("reason")))
    return rows.select("path", "outlier", "pass_one", R.release_status(F.col("override"), status, F.col("has_contract"), F.col("pass_one")).alias("release"), R.pixel_agreement(status, F.col("best"), F.col("target"), F.col("agreeing")).alias("agreement"), R.target_basis(status).alias("basis"))


@register("k1_ratchet", f"""WITH {_SCAN}, f AS (SELECT path, 'own' AS metric, own AS floor, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE own - (doc_id % 5) / 100.0 END AS value FROM scan UNION ALL SELECT path, 'r1', r1, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE r1 END FROM scan)
SELECT path, metric, CASE WHEN value IS NULL THEN 'MISSING' WHEN value < floor - 0.02 THEN 'REGRESSED' ELSE 'OK' END AS verdict FROM f""")
def ratchet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each baseline metric's verdict against a later report."""
    base = scan(spark, sf_dir)
    later = base.where("doc_id % 9 <> 0").select("path", (F.col("own") - (F.col("doc_id") % 5) / 100.0).alias("own"), "r1")
    return R.regressions(base.select("path", "own", "r1"), later, ["path"], ["own", "r1"]).select("path", "metric", "verdict")


@register("k4_two_way_difference", "SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def both_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.two_way_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


_FEATURES = "files AS (SELECT doc_id AS file, list_distinct([lang, source, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END, CASE WHEN contains(text, '@') THEN 'mail' ELSE 'plain' END]) AS features FROM documents), needs AS (SELECT * FROM (VALUES ('r1', ['en', 'long'], 'all'), ('r2', ['mail', 'de'], 'any'), ('r3', ['xx'], 'any'), ('r4', ['src1', 'short'], 'all')) AS t(requirement, needed, mode))"


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    files = d.select(F.col("doc_id").alias("file"), F.array("lang", "source", F.when(F.col("n_chars") > 2000, "long").otherwise("short"), F.when(F.contains("text", F.lit("@")), "mail").otherwise("plain")).alias("features"))
    needs = spark.createDataFrame([("r1", ["en", "long"], "all"), ("r2", ["mail", "de"], "any"), ("r3", ["xx"], "any"), ("r4", ["src1", "short"], "all")], "requirement string, needed array<string>, mode string")
    return files, needs


@register("k5_requirements", f"WITH {_FEATURES} SELECT requirement, file FROM needs, files WHERE CASE mode WHEN 'any' THEN len(list_intersect(needed, features)) > 0 ELSE len(list_intersect(needed, features)) = len(needed) END")
def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.requirement_matches(*_files(spark, sf_dir))


@register("k12_feature_inventory", f"WITH {_FEATURES}, x AS (SELECT file, unnest(features) AS feature FROM files) SELECT feature, count(*) AS n, min(file) AS first_file, max(file) AS last_file FROM x GROUP BY 1")
def feature_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with their counts and the ends of their inverted index."""
    files, _ = _files(spark, sf_dir)
    return files.select("file", F.explode(F.array_distinct("features")).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), F.min("file").alias("first_file"), F.max("file").alias("last_file"))


@register("k13_unmet_features", f"WITH {_FEATURES} SELECT DISTINCT f AS feature FROM (SELECT unnest(needed) AS f FROM needs) WHERE f NOT IN (SELECT unnest(features) FROM files)")
def unmet_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, needs = _files(spark, sf_dir)
    return needs.select(F.explode("needed").alias("feature")).distinct().join(files.select(F.explode("features").alias("feature")), "feature", "left_anti")


@register("k15_validation", "SELECT md5(text) AS digest, count(*) AS n, bool_or(lang NOT IN ('en', 'de', 'fr', 'es')) AS bad_lang, bool_or(text IS NULL OR length(text) <> n_chars) AS bad_length FROM documents GROUP BY 1 HAVING count(*) > 1 OR bool_or(lang NOT IN ('en', 'de', 'fr', 'es')) OR bool_or(text IS NULL OR length(text) <> n_chars)")
def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that occur twice, have an unknown language, or a length that differs from their text's."""
    bad_lang = F.bool_or(~F.col("lang").isin("en", "de", "fr", "es"))
    bad_length = F.bool_or(F.col("text").isNull() | (F.length("text") != F.col("n_chars")))
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), bad_lang.alias("bad_lang"), bad_length.alias("bad_length")).where("n > 1 or bad_lang or bad_length")


@register("k16_headings", """WITH h AS (SELECT page_id, unnest(list_transform(regexp_extract_all(html, '<(?:h1|p|li)>([^<]*)</', 1), lambda x, i: {'i': i, 'h': left(trim(regexp_replace(x, '\\s+', ' ', 'g')), 140)})) AS x FROM pages),
first AS (SELECT page_id, x.h AS heading, min(x.i) AS place FROM h WHERE x.h <> '' GROUP BY 1, 2)
SELECT page_id, heading, CAST(n AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place) AS n FROM first) WHERE n <= 5""")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five different labels of each page, white space collapsed, at most 140 characters long (a limit of the report)."""
    labels = F.transform(F.regexp_extract_all("html", F.lit("<(?:h1|p|li)>([^<]*)</"), F.lit(1)), lambda x: F.substring(F.trim(F.regexp_replace(x, r"\s+", " ")), 1, 140))
    once = F.slice(F.array_distinct(F.filter(labels, lambda x: x != "")), 1, 5)
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(once).alias("_n", "heading")).select("page_id", "heading", (F.col("_n") + 1).alias("n"))


@register("k20_slowest", f"WITH {_SCAN} SELECT path, elapsed_ms FROM scan ORDER BY elapsed_ms DESC, path LIMIT 5")
def slowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir).orderBy(F.desc("elapsed_ms"), "path").limit(5).select("path", "elapsed_ms")


@register("s2_newest_revision", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def newest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entry of each object."""
    found = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x"))
    return found.select("user_id", "x.event_id", "x.event_type")


@register("s7_discovery", f"WITH {_SCAN}, r AS (SELECT path, row_number() OVER (PARTITION BY source ORDER BY path) - 1 AS n FROM scan) SELECT path, CAST(n AS INTEGER) AS position, CAST(n % 4 AS INTEGER) AS chunk FROM r")
def discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of each source in ordinal order, dealt over four chunks."""
    position = (F.col("nth") - 1).cast("int")
    return running(scan(spark, sf_dir).select("source", "path"), ["source"], ["path"]).select("path", position.alias("position"), (position % 4).alias("chunk"))


@register("s10_last_wins", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.last_wins(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@register("f19_csv_quote", "SELECT item_id, '\"' || replace(text, '\"', '\"\"') || '\"' AS quoted FROM benchmark")
def quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.csv_quote(F.col("text")).alias("quoted"))


@register("f24_json_getters", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.none') AS missing FROM events")
def json_getters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.none").alias("missing"))


@register("p16_permissions", "SELECT user_id, CAST(event_id & 4095 AS INTEGER) AS flags, (event_id >> 2) & 1 = 1 AS can_print, ((event_id >> 8) & 1 = 1) OR ((event_id >> 5) & 1 = 1) AS can_fill, ((event_id >> 2) & 1 = 1) AND ((event_id >> 11) & 1 = 1) AS can_print_well FROM events")
def permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permission flags by their one-based bits: print 3, fill 9 or 6, print well 3 and 12."""
    bit = lambda n: F.getbit("event_id", F.lit(n - 1)) == 1
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").bitwiseAND(F.lit(4095)).cast("int").alias("flags"), bit(3).alias("can_print"), (bit(9) | bit(6)).alias("can_fill"), (bit(3) & bit(12)).alias("can_print_well"))


@register("p20_distinct_by", f"WITH {_SCAN} SELECT source, min(path) AS path FROM scan WHERE status IN ('DIFF', 'PASS_ONE') GROUP BY source")
def distinct_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir).where(F.col("status").isin("DIFF", "PASS_ONE")).groupBy("source").agg(F.min("path").alias("path"))


@register("f8_bigram_similarity", """WITH k AS (SELECT page_id, lower(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^A-Za-z0-9]', '', 'g')) AS a, lower(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '[^A-Za-z0-9]', '', 'g')) AS b FROM pages),
g AS (SELECT *, list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) AS ga, list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) AS gb FROM k)
SELECT page_id, CASE WHEN length(a) < 2 AND length(b) < 2 THEN 1.0 ELSE round(len(list_intersect(ga, gb)) / CAST(len(ga) + len(gb) - len(list_intersect(ga, gb)) AS DOUBLE), 6) END AS similarity FROM g""")
def bigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the title and the heading of a page are."""
    part = lambda tag: T.confidence_key(F.regexp_extract("html", f"<{tag}>([^<]*)</{tag}>", 1))
    return table(spark, sf_dir, "pages").select("page_id", F.round(T.bigram_jaccard(part("title"), part("h1")), 6).alias("similarity"))
