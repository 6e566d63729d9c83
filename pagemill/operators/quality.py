"""Scan entries under contracts: what is released, how good it is, and what waits for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators import reports as R

#: Marks of contracts that a machine has written.
GENERATED_CAUSE = "FULL_CORPUS_BASELINE"
GENERATED_MARKS = ("baseline", "auto-classified", "promote to a reviewed contract")


def _marked(value: Column) -> Column:
    low = F.lower(F.coalesce(value, F.lit("")))
    found = F.lit(False)
    for mark in GENERATED_MARKS:
        found = found | F.contains(low, F.lit(mark))
    return found


def agreement_under_contract(status: Column, proposed: Column, inferred: Column) -> Column:
    """What a contract says of the pixels, overruled where the raw status of the page contradicts it."""
    found = F.when((status == "PASS_ONE") & (proposed == "MATCHES_NONE"), inferred).when(status == "PASS", "MATCHES_ALL_REQUIRED")
    return found.when((status == "DIFF") & ~proposed.isin("MATCHES_NONE", "NOT_COMPARABLE"), "MATCHES_NONE").otherwise(proposed)


def with_contracts(entries: DataFrame, contracts: DataFrame, strict: bool = False) -> DataFrame:
    """entries (path, page_no, status, result, result_category, result_reason, expected_note, compared, agreeing, pairs, disagreeing, rank, best) with what follows
    from the contract of their page (sources.contracts), one row for each entry.

    Each of quality_status, pixel_agreement, reference_situation, target_basis, target_renderer, root_cause, priority, confidence, quality_reason and release_status is what the
    page's contract says, else its document's, else inferred from the entry. Raw statuses overrule a contract's pixel agreement. A page that matches one
    renderer is accepted only if somebody reviewed it or nothing about its contract or its numbers is odd; failed and blocked ones are rejected; others are to be reviewed. With
    strict, entries without a contract are to be reviewed too. Contracts name each page at most once.
    """
    page = contracts.select(*(F.col(c).alias(f"_{c}") for c in contracts.columns), F.lit(True).alias("_known"))
    e = entries.join(page, (F.col("path") == F.col("_path")) & (F.col("page_no") == F.col("_page_no")), "left")
    status, known = F.col("status"), F.col("_known").isNotNull()
    inferred = R.pixel_agreement(status, F.col("best"), F.col("_target_renderer"), F.col("agreeing"))
    strictly = F.lit(strict) & ~known
    quality = R.given(F.col("_quality_status"), R.quality_status(status, F.col("result"), known, strict))
    reason = F.when(strictly, "No contract covers this page.").otherwise(R.given(F.col("_quality_reason"), F.col("_notes"), F.col("result_reason"), F.col("expected_note")))
    release = F.when(strictly, "NEEDS_REVIEW").otherwise(R.given(F.col("_release_status"), F.lit("PASS")))
    odd = R.outlier(F.col("compared"), F.col("agreeing"), F.col("pairs"), F.col("disagreeing"), F.col("rank"))
    made = (F.col("_root_cause") == GENERATED_CAUSE) | _marked(F.col("_quality_reason")) | _marked(F.col("_notes")) | _marked(F.col("_target_reason"))
    told = F.coalesce("_quality_reason", "_notes").isNotNull()
    review = F.when(status != "PASS_ONE", "N/A").when(release.isin("BLOCKED", "FAIL") | (quality == "FAIL"), "rejected").when(~known, "unreviewed")
    review = review.when(F.col("_review_status") == "REVIEWED", "accepted").when(F.col("_review_status").isin(*R.UNREVIEWED), "unreviewed")
    review = review.when(F.coalesce(made, F.lit(False)) | F.coalesce(odd, F.lit(False)) | ~F.coalesce("_has_target", F.lit(False)) | ~told, "unreviewed").otherwise("accepted")
    columns = {
        "contract_status": F.when(known, "APPLIED").otherwise("MISSING"), "pass_one_review": review, "release_status": release, "quality_status": quality,
        "pixel_agreement": agreement_under_contract(status, R.given(F.col("_pixel_agreement"), inferred), inferred),
        "reference_situation": R.given(F.col("_reference_situation"), R.reference_situation(status, F.col("compared"), F.col("disagreeing"))),
        "target_basis": R.given(F.col("_target_mode"), R.target_basis(status)), "target_renderer": F.col("_target_renderer"),
        "root_cause": R.given(F.col("_root_cause"), F.col("result_category"), F.lit("UNKNOWN")), "priority": R.given(F.col("_priority"), R.improvement_priority(status)),
        "confidence": R.given(F.col("_confidence"), R.confidence(status, F.col("compared"))), "tracked_by": F.concat(F.lit("#"), "_issue"), "quality_reason": reason,
    }
    found = e.select(*(F.col(c) for c in entries.columns), *(c.alias(n) for n, c in columns.items()))
    open_ = F.col("pass_one_review") == "unreviewed"
    note = F.when(odd, "Only a renderer outside the consensus agrees; a target has to be chosen.").otherwise("No reviewed target yet.")
    return found.withColumn("quality_reason", F.when(open_, R.given(F.col("quality_reason"), note)).otherwise(F.col("quality_reason"))).withColumn("release_status", F.when(open_, "NEEDS_REVIEW").otherwise(F.col("release_status"))).withColumn("quality_status", F.when(open_, "NEEDS_REVIEW").otherwise(F.col("quality_status")))


SUMMARISED = ("status", "release_status", "quality_status", "pixel_agreement", "reference_situation", "target_basis", "root_cause", "priority", "confidence", "pass_one_review", "contract_status")


def summary(judged: DataFrame) -> DataFrame:
    """(field, value, n): counts of each of SUMMARISED over all entries, in one pass; an entry without a value counts as UNKNOWN."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("UNKNOWN")).alias("value")) for f in SUMMARISED))
    return judged.select(F.explode(fields).alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))
