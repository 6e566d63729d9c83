"""Contract files: what reviewers have agreed for the pages of each document, read as rows and checked before use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.text import manifest_path

_TARGET = "struct<Mode:string,Primary:string,Reason:string>"
_OWN = f"RootCause:string,ReviewStatus:string,ImprovementPriority:string,Confidence:string,QualityReason:string,Notes:string,Issue:int,Target:{_TARGET}"
_PAGE = f"struct<ExpectedRawStatus:string,ReleaseStatus:string,QualityStatus:string,PixelAgreement:string,ReferenceSituation:string,{_OWN}>"
SCHEMA = f"Path string, Source string, RootCause string, ReviewStatus string, ImprovementPriority string, Confidence string, QualityReason string, Notes string, Issue int, Target {_TARGET}, Pages map<string,{_PAGE}>"
#: The words that each field may have (one quality word is this library's own).
WORDS = {
    "raw_status": "* PASS PASS_ONE DIFF COMPARE_ERROR ALL_ORACLES_REFUSED RECOVERED_MALFORMED_CONTENT DECODE_ERROR MALFORMED_PDF EMPTY_DOC PASSWORD_REQUIRED RESOURCE_LIMIT INVALID_PAGE_GEOMETRY TIMEOUT UNSUPPORTED_COMPRESSION",
    "release_status": "PASS FAIL BLOCKED NEEDS_REVIEW",
    "quality_status": "PIXEL_EXACT TARGET_MATCH MATCHES_ACCEPTED_REFERENCE REFERENCE_REFUSAL_ACCEPTED GOOD_ENOUGH BETTER_THAN_REFS ACCEPTED_LIMITATION LOWER_QUALITY_ACCEPTABLE NON_RENDERABLE_ACCEPTED FAIL NEEDS_REVIEW",
    "pixel_agreement": "MATCHES_ALL_REQUIRED MATCHES_TARGET MATCHES_SOME MATCHES_ONE_REFERENCE MATCHES_NONE NOT_COMPARABLE",
    "reference_situation": "REFS_AGREE REFS_DISAGREE REFS_REFUSE REFS_INCOMPLETE REFS_WRONG_OR_LOSSY NOT_APPLICABLE",
    "target_mode": "ACCEPTED_REFERENCE PDF_FONT_DICTIONARY_WITH_REFERENCE_EVIDENCE PREPRESS_REFERENCE_WITH_ALTONA_SEMANTICS REFERENCE_RENDERER REFERENCE_CONSENSUS REFERENCE_CONSENSUS_FIXED REFERENCE_DISAGREEMENT PDF_SPEC QUALITY_STANDARD RESOURCE_POLICY REFERENCE_REFUSAL MALFORMED_INPUT_POLICY",
    "review_status": "REVIEWED GENERATED NEEDS_REVIEW",
    "priority": "P0 P1 P2 NONE DONE",
    "confidence": "HIGH MEDIUM LOW",
}
#: Quality words that a page without comparable pixels cannot have; the last one only where none can be compared.
COMPARED = ("PIXEL_EXACT", "TARGET_MATCH", "MATCHES_ACCEPTED_REFERENCE")
#: Columns that a page has of its own, or else from its document.
SHARED = {"root_cause": "RootCause", "review_status": "ReviewStatus", "priority": "ImprovementPriority", "confidence": "Confidence", "quality_reason": "QualityReason", "notes": "Notes", "issue": "Issue"}


def _blank(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def read_contract_pages(spark: SparkSession, folder: str, one_per_file: bool = True) -> DataFrame:
    """A row for each page that a contract names: file, path, page_key, page_no and the fields of WORDS and SHARED with their target.

    Files are *.json below the folder whose name does not start with _; with one_per_file off they hold a contract on each line. A key is a number or a range such as
    2-5; any other gives page_no null. page_* columns hold what the page itself says, the plain ones that or else what its document says; a blank is nothing.
    A contract without pages is a row with page_key null.
    """
    rows = spark.read.schema(SCHEMA).option("multiLine", one_per_file).option("recursiveFileLookup", True).option("pathGlobFilter", "[!_]*.json").json(folder)
    each = rows.select(F.col("_metadata.file_path").alias("file"), manifest_path(F.col("Path")).alias("path"), *(F.col(c).alias(f"_d_{c}") for c in (*SHARED.values(), "Target")), F.explode_outer("Pages").alias("page_key", "_p"))
    key = F.trim("page_key")
    low = F.regexp_extract(key, r"^(\d+)(-\d+)?$", 1).try_cast("int")
    high = F.coalesce(F.regexp_extract(key, r"^\d+-(\d+)$", 1).try_cast("int"), low)
    numbers = F.when(low <= high, F.sequence(low, high)).otherwise(F.array(F.lit(None).cast("int")))
    own = {"raw_status": "ExpectedRawStatus", "release_status": "ReleaseStatus", "quality_status": "QualityStatus", "pixel_agreement": "PixelAgreement", "reference_situation": "ReferenceSituation"}
    columns = [_blank(F.col(f"_p.{source}")).alias(name) for name, source in own.items()]
    for name, source in SHARED.items():
        page, whole = F.col(f"_p.{source}"), F.col(f"_d_{source}")
        columns += [F.coalesce(page, whole).alias(name)] if name == "issue" else [_blank(page).alias(f"page_{name}"), F.coalesce(_blank(page), _blank(whole)).alias(name)]
    target = F.coalesce("_p.Target", "_d_Target")
    columns += [_blank(target["Mode"]).alias("target_mode"), _blank(target["Primary"]).alias("target_renderer"), _blank(target["Reason"]).alias("target_reason"), target.isNotNull().alias("has_target")]
    return each.withColumn("page_no", F.explode(numbers)).select("file", "path", "page_key", "page_no", *columns)


def problems(pages: DataFrame) -> DataFrame:
    """(file, path, page_no, problem): what is wrong with contract pages, each thing a row; none if they can be used."""
    fault = lambda when, text: F.when(when, text)
    found = [fault(F.coalesce(F.col("path"), F.lit("")) == "", F.lit("no path")), fault(F.col("page_key").isNull(), F.lit("no pages")), fault(F.col("page_key").isNotNull() & F.col("page_no").isNull(), F.concat(F.lit("page key "), "page_key"))]
    for name, words in WORDS.items():
        found.append(fault(~F.col(name).isin(*words.split()), F.concat(F.lit(f"{name} "), name)))
    apart = F.col("pixel_agreement").isin("MATCHES_NONE", "NOT_COMPARABLE")
    found.append(fault(F.col("raw_status").isin("PASS", "PASS_ONE") & apart, F.lit("pixel_agreement against raw_status")))
    found.append(fault((F.col("quality_status") == "FAIL") & (F.col("release_status") == "PASS"), F.lit("quality FAIL with release PASS")))
    found.append(fault(F.col("quality_status").isin(*COMPARED) & apart | (F.col("quality_status") == "GOOD_ENOUGH") & (F.col("pixel_agreement") == "NOT_COMPARABLE"), F.lit("pixel_agreement against quality_status")))
    single = pages.select("file", "path", "page_no", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("problem"))
    twice = pages.where("page_no is not null").groupBy("path", "page_no").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("file")).where("n > 1")
    return single.unionByName(twice.select("file", "path", "page_no", F.lit("named twice").alias("problem")))


def load_contracts(spark: SparkSession, folder: str, one_per_file: bool = True) -> DataFrame:
    """read_contract_pages of a folder without problems; otherwise an error that tells the first ten."""
    pages = read_contract_pages(spark, folder, one_per_file)
    wrong = problems(pages).orderBy("file", "page_no", "problem").limit(10).collect()
    if wrong:
        raise ValueError("; ".join(f"{r.file} {r.path} page {r.page_no}: {r.problem}" for r in wrong))
    return pages
