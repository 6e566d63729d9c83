"""Corpora as folders of files: discovery with an include list, in ordinal order, dealt over chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.text import manifest_path
from pagemill.operators.ranges import running


def discover(spark: SparkSession, folder: str, pattern: str = "*.pdf", include: DataFrame | None = None) -> DataFrame:
    """(path, size, position): the files below a folder whose name fits, by their path below it and numbered from 0 in the order of its bytes.

    Spark lists the folder on its executors; contents are not read. include (path) keeps only those files; its paths are trimmed, with slashes. An empty
    folder gives no rows.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = fs.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(fs).toUri().getPath().rstrip("/") + "/"
    whole = F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    below = listed.select(F.substring(whole, F.lit(len(root) + 1), F.length(whole)).alias("path"), F.col("length").alias("size"))
    if include is not None:
        below = below.join(include.select(manifest_path(F.col("path")).alias("path")).distinct(), "path", "left_semi")
    found = running(below.withColumn("_all", F.lit(1)), ["_all"], ["path"])
    return found.select("path", "size", (F.col("nth") - 1).alias("position"))


def chunk(found: DataFrame, index: int, total: int) -> DataFrame:
    """The files of one of `total` chunks: every total-th from the index on, so that chunks together have each file once."""
    if not 0 <= index < total:
        raise ValueError(f"chunk {index} of {total}")
    return found.where(F.col("position") % total == index)
