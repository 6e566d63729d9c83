"""Corpus reports: counts, percentiles, shares, clusters, lookups with fallback keys, baselines and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators.ranges import nearest_ranks


def blank_as(value: Column, bucket: str) -> Column:
    """The value, or a named bucket where it is null or blank."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(bucket))


def counts_by(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """Group counts, largest first, then by key."""
    return rows.groupBy(key.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def measured(value: Column) -> Column:
    """A measurement, null where a negative number says that nothing was measured."""
    return F.when(value >= 0, value)


def average(value: Column, digits: int = 6) -> Column:
    """Aggregate: the mean, 0 of an empty group."""
    return F.coalesce(F.round(F.avg(value), digits), F.lit(0.0))


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles of each group, one column for each name; nulls are left out, groups without values give 0."""
    return nearest_ranks(rows, keys, value, shares)


def ratio(part: Column, whole: Column, digits: int = 6) -> Column:
    """part / whole, null when whole is 0."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def with_share(groups: DataFrame, total: str, digits: int = 6) -> DataFrame:
    """groups with each one's share of the grand total of a column."""
    return groups.withColumn("share", F.round(F.col(total) / F.sum(total).over(Window.partitionBy()), digits))


def clusters(rows: DataFrame, keys: list[str], member: Column, most: int = 12) -> DataFrame:
    """Groups over several keys with blanks as 'none', their size and their first `most` members in order.

    Members are ranked apart from the count, so that of a large group each task sends only its first ones on.
    """
    named = rows.select(*(blank_as(F.col(k).cast("string"), "none").alias(k) for k in keys), member.alias("member"))
    ranked = named.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("member"))).where(F.col("_r") <= most)
    first = ranked.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("member")), ",").alias("members"))
    return named.groupBy(*keys).agg(F.count("*").alias("n")).join(first, keys)


def looked_up(entries: DataFrame, known: DataFrame, value: str, prefix: str) -> DataFrame:
    """entries (path, …) left joined to known (path, value) by the exact path, else with the prefix added where the path has no
    slash, else with the prefix stripped. The first key that is known wins."""
    path = F.col("path")
    keys = F.array(path, F.when(~F.contains(path, F.lit("/")), F.concat(F.lit(prefix), path)), F.when(F.startswith(path, F.lit(prefix)), F.substring(path, F.lit(len(prefix) + 1), F.length(path))))
    tried = entries.select("path", F.posexplode(keys).alias("rank", "key")).where("key is not null").distinct()
    found = tried.join(known.select(F.col("path").alias("key"), value), "key").groupBy("path").agg(F.min_by(value, "rank").alias(value))
    return entries.join(found, "path", "left")


def last_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row a key; of repeated keys the last row's value."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def unpivoted(rows: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """One row for each key and measured column; nulls and negative sentinels are left out."""
    return rows.unpivot(keys, columns, name, value).where(F.col(value) >= 0)


def regressions(baseline: DataFrame, report: DataFrame, keys: list[str], metrics: list[str], slack: float = 0.02) -> DataFrame:
    """(keys, metric, floor, value, verdict): REGRESSED below floor - slack, MISSING without a report row, else OK."""
    floors = baseline.unpivot(keys, metrics, "metric", "floor")
    values = report.unpivot(keys, metrics, "metric", "value")
    verdict = F.when(F.col("value").isNull(), "MISSING").when(F.col("value") < F.col("floor") - slack, "REGRESSED").otherwise("OK")
    return floors.join(values, [*keys, "metric"], "left").withColumn("verdict", verdict)


def two_way_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of a only and of b only."""
    only_a = a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("left"))
    only_b = b.select(key).distinct().join(a.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("right"))
    return only_a.unionByName(only_b)


def requirement_matches(files: DataFrame, requirements: DataFrame) -> DataFrame:
    """(requirement, file) pairs: files (file, features), requirements (requirement, needed, mode any or all); nothing needed, no match.

    Needed features are exploded and counted, so that the pairs come from an equi-join.
    """
    needed = requirements.select("requirement", "mode", F.size(F.array_distinct("needed")).alias("n"), F.explode(F.array_distinct("needed")).alias("feature"))
    has = files.select("file", F.explode(F.array_distinct("features")).alias("feature"))
    met = needed.join(has, "feature").groupBy("requirement", "mode", "n", "file").agg(F.count("*").alias("met"))
    return met.where("mode = 'any' or met = n").select("requirement", "file")


def until_first_failure(steps: DataFrame, group: str, order: str, failed: Column) -> DataFrame:
    """Steps of each group up to and including the first that failed."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("_f", F.coalesce(F.sum(failed.cast("int")).over(before), F.lit(0))).where("_f = 0").drop("_f")


#: A check of a gate: its name, the measure it looks at, its bound, whether that is the least or the most, and its unit.
Check = tuple[str, str, float, str, str]


def gate(measures: DataFrame, keys: list[str], checks: list[Check]) -> DataFrame:
    """(keys, check, actual, threshold, unit, passed, gate_passed): each check of each row of measures, without those whose measure is null, as it was not
    taken. gate_passed holds where all its checks passed, also where none was left."""
    rows = F.array(*(F.struct(F.lit(name).alias("check"), F.col(measure).cast("double").alias("actual"), F.lit(float(bound)).alias("threshold"), F.lit(unit).alias("unit"), (F.col(measure) >= bound if side == "least" else F.col(measure) <= bound).alias("passed")) for name, measure, bound, side, unit in checks))
    taken = measures.withColumn("_c", F.filter(rows, lambda c: c["actual"].isNotNull()))
    return taken.withColumn("gate_passed", F.forall("_c", lambda c: c["passed"])).select(*keys, "gate_passed", F.explode("_c").alias("c")).select(*keys, "c.*", "gate_passed")


def pairs_in_group(rows: DataFrame, keys: list[str], ordinal: str, value: str) -> DataFrame:
    """Unordered pairs of a bounded set of measurements in each group, with their absolute difference."""
    a = rows.select(*keys, F.col(ordinal).alias("first"), F.col(value).alias("_x"))
    b = rows.select(*keys, F.col(ordinal).alias("second"), F.col(value).alias("_y"))
    return a.join(b, keys).where("first < second").withColumn("difference", F.abs(F.col("_x") - F.col("_y"))).drop("_x", "_y")


def disagreement(disagreeing: Column, pairs: Column) -> Column:
    return F.when(pairs == 0, "unmeasured").when(disagreeing == 0, "none").when(disagreeing == pairs, "all").otherwise("some")


#: Raw statuses and the quality status that each implies.
QUALITY = {"PASS": "PIXEL_EXACT", "PASS_ONE": "MATCHES_ACCEPTED_REFERENCE", "ALL_ORACLES_REFUSED": "REFERENCE_REFUSAL_ACCEPTED", "DIFF": "FAIL"}
NOT_RENDERABLE = ("RECOVERED_MALFORMED_CONTENT", "MALFORMED_PDF", "EMPTY_DOC", "PASSWORD_REQUIRED", "RESOURCE_LIMIT", "INVALID_PAGE_GEOMETRY")


def quality_status(status: Column, result: Column, has_contract: Column, strict: bool = False) -> Column:
    found = F.when(F.lit(strict) & ~has_contract, "NEEDS_REVIEW")
    for raw, quality in QUALITY.items():
        found = found.when(status == raw, quality)
    return found.when(status.isin(*NOT_RENDERABLE), "NON_RENDERABLE_ACCEPTED").when(result == "PASS", "GOOD_ENOUGH").otherwise("FAIL")


def reference_situation(status: Column, compared: Column, disagreeing: Column) -> Column:
    return F.when(status == "ALL_ORACLES_REFUSED", "REFS_REFUSE").when(F.coalesce(compared, F.lit(0)) == 0, "REFS_INCOMPLETE").when(disagreeing > 0, "REFS_DISAGREE").otherwise("REFS_AGREE")


def improvement_priority(status: Column) -> Column:
    return F.when(status == "DIFF", "P1").when(status == "PASS_ONE", "P2").otherwise("NONE")


def confidence(status: Column, compared: Column) -> Column:
    return F.when(status == "PASS", "HIGH").when(status == "PASS_ONE", F.when(compared >= 3, "MEDIUM").otherwise("LOW")).otherwise("MEDIUM")


#: Raw statuses of malformed inputs, and the markers of contracts that nobody has reviewed.
MALFORMED = ("MALFORMED_PDF", "EMPTY_DOC", "PASSWORD_REQUIRED", "INVALID_PAGE_GEOMETRY")
UNREVIEWED = ("GENERATED", "NEEDS_REVIEW")


def given(*values: Column) -> Column:
    """The first value that is not blank: a page's own, else its contract's, else what is inferred."""
    return F.coalesce(*(F.when(F.trim(v) != "", v) for v in values))


def outlier(compared: Column, agreeing: Column, pairs: Column, disagreeing: Column, rank: Column) -> Column:
    """Of three or more references, one alone agrees although no pair of them disagrees, or at most one does and the rank is third or worse."""
    alone = (agreeing == 1) & (pairs > 0) & (disagreeing == 0)
    return (compared >= 3) & (alone | ((agreeing <= 1) & (rank >= 3)))


def pixel_agreement(status: Column, best: Column, primary: Column, agreeing: Column) -> Column:
    one = F.when(best == primary, "MATCHES_TARGET").when(agreeing == 1, "MATCHES_ONE_REFERENCE").otherwise("MATCHES_SOME")
    return F.when(status == "PASS", "MATCHES_ALL_REQUIRED").when(status == "PASS_ONE", one).when(status == "DIFF", "MATCHES_NONE").otherwise("NOT_COMPARABLE")


def target_basis(status: Column) -> Column:
    found = F.when(status.isin(*MALFORMED), "MALFORMED_INPUT_POLICY").when(status.isin("RESOURCE_LIMIT", "TIMEOUT"), "RESOURCE_POLICY")
    return found.when(status == "ALL_ORACLES_REFUSED", "QUALITY_STANDARD").when(status == "PASS_ONE", "REFERENCE_DISAGREEMENT").otherwise("REFERENCE_CONSENSUS")


def pass_one_review(status: Column, quality: Column, has_contract: Column, review: Column, is_outlier: Column, target: Column, reason: Column) -> Column:
    """accepted only when somebody reviewed it, or when a contract without a marker gives a target and a reason and nothing is odd."""
    found = F.when(status != "PASS_ONE", "N/A").when(quality == "FAIL", "rejected").when(~has_contract, "unreviewed").when(review == "REVIEWED", "accepted")
    return found.when(review.isin(*UNREVIEWED) | is_outlier | (F.coalesce(target, F.lit("")) == "") | (F.coalesce(reason, F.lit("")) == ""), "unreviewed").otherwise("accepted")


def release_status(override: Column, status: Column, has_contract: Column, review: Column, strict: bool = False) -> Column:
    found = F.when(F.lit(strict) & ~has_contract, "NEEDS_REVIEW").when((status == "PASS_ONE") & (review == "unreviewed"), "NEEDS_REVIEW").otherwise("PASS")
    return given(override, found)
