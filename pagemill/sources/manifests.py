"""Readers of manifests and reports: tab-separated page, password and expectation lists, contract JSON, scan reports, OCR tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pagemill.functions.geometry import rect
from pagemill.functions.text import manifest_path


def _fields(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Tab-separated fields of each line with its place; blank lines, comments (#) and a header in the first line are left out.

    A missing field is empty. Places order lines within a file; files are ordered by name.
    """
    lines = spark.read.text(path).select(F.col("value"), F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("place"))
    rows = lines.where((F.trim("value") != "") & ~F.startswith(F.trim("value"), F.lit("#"))).withColumn("f", F.split("value", "\t", -1))
    header = F.lower(F.trim(F.get("f", F.lit(0)))) == "path"
    return rows.where(~header).select("place", *(F.trim(F.coalesce(F.get("f", F.lit(i)), F.lit(""))).alias(n) for i, n in enumerate(names)))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_no) of a page manifest, each once."""
    return _fields(spark, path, ["path", "page_no"]).select(manifest_path(F.col("path")).alias("path"), F.col("page_no").try_cast("int").alias("page_no")).where("page_no is not null").distinct()


def read_passwords(spark: SparkSession, path: str) -> DataFrame:
    """(path, password); of repeated paths the last line counts."""
    return _fields(spark, path, ["path", "password"]).groupBy(manifest_path(F.col("path")).alias("path")).agg(F.max_by("password", "place").alias("password"))


def read_expectations(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_no, status, error_contains, note, result_status, result_category, result_reason); the last line of a key counts."""
    names = ["path", "page_no", "status", "error_contains", "note", "result_status", "result_category", "result_reason"]
    rows = _fields(spark, path, names).withColumn("path", manifest_path(F.col("path"))).withColumn("page_no", F.col("page_no").try_cast("int"))
    last = rows.groupBy("path", "page_no").agg(F.max_by(F.struct(*names[2:]), "place").alias("x"))
    return last.select("path", "page_no", "x.*")


CONTRACT = "Path string, Source string, ReviewStatus string, QualityReason string, Notes string, Pages map<string, struct<ExpectedRawStatus:string,ReleaseStatus:string,QualityStatus:string,PixelAgreement:string>>"


def read_contracts(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each contract page: page keys '3' and '1-2' are expanded, files whose name starts with _ are left out.

    A key of another form gives a null page, and a repeated (path, page) is in `duplicate_contracts`.
    """
    rows = spark.read.schema(CONTRACT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "[!_]*.json").json(folder)
    pages = rows.select("Path", "Source", "ReviewStatus", "QualityReason", "Notes", F.explode_outer("Pages").alias("key", "page"))
    lo = F.regexp_extract("key", r"^(\d+)(-\d+)?$", 1).try_cast("int")
    hi = F.coalesce(F.regexp_extract("key", r"^\d+-(\d+)$", 1).try_cast("int"), lo)
    numbers = F.when(lo.isNotNull() & (lo <= hi), F.sequence(lo, hi)).otherwise(F.array(F.lit(None).cast("int")))
    return pages.withColumn("page_no", F.explode(numbers)).select(F.col("Path").alias("path"), "page_no", F.col("page.ExpectedRawStatus").alias("raw_status"), F.col("page.ReleaseStatus").alias("release_status"), F.col("page.QualityStatus").alias("quality_status"), F.col("page.PixelAgreement").alias("pixel_agreement"), F.col("ReviewStatus").alias("review_status"))


def duplicate_contracts(contracts: DataFrame) -> DataFrame:
    return contracts.groupBy("path", "page_no").agg(F.count("*").alias("n")).where("n > 1")


def read_scan_report(spark: SparkSession, path: str, entry: StructType) -> DataFrame:
    """Entries of scan reports; a report whose entries are not an array gives none."""
    whole = StructType([StructField("entries", StringType())])
    found = spark.read.schema(whole).option("multiLine", True).json(path)
    return found.select(F.explode(F.from_json("entries", f"array<{entry.simpleString()}>")).alias("e")).select("e.*")


def read_ocr_words(spark: SparkSession, path: str, dpi: int = 300, page_height: float = 792.0) -> DataFrame:
    """(text, confidence, box) of OCR word rows (level 5, twelve fields, not blank): pixels as points from the bottom left."""
    f = lambda i: F.get("f", F.lit(i))
    scale = 72.0 / dpi
    rows = spark.read.text(path).select(F.split("value", "\t", -1).alias("f")).where((F.size("f") >= 12) & (f(0) == "5") & (F.trim(f(11)) != ""))
    left, top, width, height = (f(i).try_cast("double") * scale for i in (6, 7, 8, 9))
    return rows.select(f(11).alias("text"), (f(10).try_cast("float") / 100).alias("confidence"), rect(left, page_height - top - height, left + width, page_height - top).alias("box"))
