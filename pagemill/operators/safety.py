"""Safety report on redacted copies: what was asked for, what is still there, and what has to be looked at, one row for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.spatial import crossing_pairs

#: Fixed value: shorter previews are not looked for.
SHORTEST_PREVIEW = 3


def searchable(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _status(checked: Column, found: Column) -> Column:
    return F.when(~checked, "NotChecked").when(found > 0, "Warning").otherwise("Verified")


def safety_report(docs: DataFrame, requests: DataFrame, hidden: DataFrame, images: DataFrame, scrub_metadata: bool = True, scrub_attachments: bool = True, verify_text: bool = True, audit_hidden: bool = True, audit_images: bool = True) -> DataFrame:
    """A row for each of docs (doc_id, text, n_pages, info_fields, has_xmp, n_embedded), with counters, statuses and warnings.

    requests (doc_id, page_no, area, preview) are the redactions that were asked for, hidden (doc_id, ...) the hidden texts found, images (doc_id, page_no, box) the
    images drawn. Requests on pages that a document does not have are counted as skipped. Previews are compared without regard to case and white space, each once; short ones
    are counted and not looked for. An image counts once for each area that it crosses. What is switched off, or has nothing to check, is NotChecked. Null texts hold nothing; a
    document that is not among docs has no row; doc_id is unique in docs.
    """
    pages = docs.select("doc_id", "n_pages")
    placed = requests.join(pages, "doc_id").withColumn("_on", F.col("page_no").between(1, F.col("n_pages")))
    term = F.lower(searchable(F.col("preview")))
    asked = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_areas"), F.count_if(~F.coalesce("_on", F.lit(False))).alias("n_areas_skipped"), F.collect_set(F.when(term != "", term)).alias("_terms"))
    overlaps = crossing_pairs(images.select("doc_id", "page_no", "box"), placed.where("_on").select("doc_id", "page_no", F.col("area").alias("_area")), ["doc_id", "page_no"], "box", "_area").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_image_overlaps"))
    found = docs.join(asked, "doc_id", "left").join(hidden.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hidden")), "doc_id", "left").join(overlaps, "doc_id", "left").fillna(0, ["n_areas", "n_areas_skipped", "n_hidden", "n_image_overlaps"])
    terms = F.coalesce("_terms", F.array().cast("array<string>"))
    long = F.filter(terms, lambda t: F.length(t) >= SHORTEST_PREVIEW)
    text = F.lower(searchable(F.coalesce("text", F.lit(""))))
    n, no = (lambda c, on=True: c.cast("int") if on else F.lit(0)), F.lit(0)
    counted = found.withColumn("_text", text).withColumn("n_previews", F.size(terms)).withColumn("n_previews_checked", n(F.size(long), verify_text)).withColumn("n_previews_short", n(F.size(terms) - F.size(long), verify_text))
    counted = counted.withColumn("n_previews_left", n(F.size(F.filter(long, lambda t: F.contains(F.col("_text"), t))), verify_text)).withColumn("n_hidden", F.col("n_hidden") if audit_hidden else no).withColumn("n_image_overlaps", F.col("n_image_overlaps") if audit_images else no)
    statuses = {"content_status": _status(F.lit(verify_text) & (F.col("n_previews_checked") > 0), F.col("n_previews_left")), "hidden_text_status": _status(F.lit(audit_hidden), F.col("n_hidden")), "image_status": _status(F.lit(audit_images) & (F.col("n_areas") > 0), F.col("n_image_overlaps"))}
    told = {"n_areas_skipped": "areas skipped, as their page does not exist", "n_previews_left": "captured previews still in the text", "n_hidden": "hidden texts left to look at", "n_image_overlaps": "images still cross redacted areas"}
    warnings = F.filter(F.array(*(F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {words}"))) for c, words in told.items())), lambda w: w.isNotNull())
    scrubbed = {"metadata_scrubbed": F.lit(scrub_metadata), "info_fields_scrubbed": F.col("info_fields") if scrub_metadata else no, "had_xmp": F.col("has_xmp"), "attachments_scrubbed": F.lit(scrub_metadata and scrub_attachments), "n_embedded_before": F.col("n_embedded")}
    return counted.select("doc_id", "n_areas", "n_areas_skipped", "n_previews", "n_previews_checked", "n_previews_left", "n_previews_short", *(c.alias(k) for k, c in (statuses | scrubbed).items()), "n_hidden", "n_image_overlaps", warnings.alias("warnings"), (F.size(warnings) > 0).alias("has_warnings"))
