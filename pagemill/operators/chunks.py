"""Reports of a corpus scan in chunks: one form for all, rows for what crashed, counts, slowest and failed entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The return code of a run that was stopped for its time, and the statuses that a failure list shows.
TIMED_OUT = 124
FAILED = "TIMEOUT MALFORMED_PDF UNSUPPORTED_ENCRYPTED UNSUPPORTED_COMPRESSION DECODE_ERROR RESOURCE_LIMIT INVALID_PAGE_GEOMETRY INVALID_PAGE_NUMBER PARSE_ERROR RENDER_ERROR COMPARE_ERROR ALL_ORACLES_REFUSED EMPTY_DOC RENDER_NULL SCANNER_CRASH".split()


def one_form(entries: DataFrame, names: list[str]) -> DataFrame:
    """entries with the given columns, each taken from the column of that name whose first letter may be a capital; null where there is neither."""
    have = set(entries.columns)
    pick = lambda n: next((c for c in (n, n[:1].upper() + n[1:]) if c in have), None)
    return entries.select(*((F.col(f"`{pick(n)}`") if pick(n) else F.lit(None)).alias(n) for n in names))


def crash_status(code: Column) -> Column:
    return F.when(code == TIMED_OUT, "TIMEOUT").otherwise("SCANNER_CRASH")


def with_crashed(entries: DataFrame, attempts: DataFrame) -> DataFrame:
    """entries (path, pageNumber, status, ...) and a row for each attempt (path, pageNumber, code) that has none, or whose return code is not 0.

    An attempt that failed takes the place of its entry. Such a row has the phase, the type and a message of the error; its other columns are null.
    """
    keys = ["path", "pageNumber"]
    timed_out = F.col("code") == TIMED_OUT
    bad = attempts.where("code <> 0").unionByName(attempts.where("code = 0").join(entries.select(*keys), keys, "left_anti")).dropDuplicates(keys)
    made = bad.select(*keys, crash_status(F.col("code")).alias("status"), F.lit("scan").alias("errorPhase"), F.when(timed_out, "ProcessTimeout").otherwise("ProcessExit").alias("errorType"), F.format_string("scan exited %d before writing a single-page report", "code").alias("errorMessage"))
    good = entries.join(attempts.where("code <> 0").select(*keys), keys, "left_anti")
    return good.unionByName(made, allowMissingColumns=True)


def slowest(entries: DataFrame, n: int = 10) -> DataFrame:
    """The n entries that took longest, of those that took any time; ties by path and page."""
    took = F.coalesce(F.col("elapsedMs").cast("long"), F.lit(0))
    return entries.withColumn("elapsedMs", took).where("elapsedMs > 0").orderBy(F.desc("elapsedMs"), "path", "pageNumber").limit(n)


def failures(entries: DataFrame, n: int = 20, longest: int = 140) -> DataFrame:
    """(path, pageNumber, status, phase, kind, message) of the first n failed entries by path and page; a message is cut to `longest` characters with dots at its end."""
    bad = entries.where(F.col("status").isin(*FAILED)).orderBy("path", "pageNumber").limit(n)
    message = F.coalesce("diagnostic", "errorMessage", F.lit(""))
    short = F.when(F.length(message) > longest, F.concat(F.substring(message, F.lit(1), F.lit(longest - 3)), F.lit("..."))).otherwise(message)
    return bad.select("path", "pageNumber", "status", F.coalesce("errorPhase", F.lit("-")).alias("phase"), F.coalesce("errorType", F.lit("-")).alias("kind"), short.alias("message"))
