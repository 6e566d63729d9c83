"""Page operators: splitting, merging, moving, running numbers and labels, as ordinal arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators.ranges import running


def split_every(pages: DataFrame, n: int) -> DataFrame:
    """pages with part (from 0) and the page number within it."""
    return pages.withColumn("part", F.floor((F.col("page_no") - 1) / n).cast("int")).withColumn("part_page", ((F.col("page_no") - 1) % n + 1).cast("int"))


def split_at(pages: DataFrame, starts: DataFrame) -> DataFrame:
    """pages with part: a new one at every page of starts (doc_id, page_no); the first page always starts one."""
    marks = starts.select("doc_id", "page_no").distinct().withColumn("_mark", F.lit(1))
    order = Window.partitionBy("doc_id").orderBy("page_no")
    marked = pages.join(marks, ["doc_id", "page_no"], "left").withColumn("_mark", F.when(F.col("page_no") == 1, 1).otherwise(F.coalesce("_mark", F.lit(0))))
    return marked.withColumn("part", (F.sum("_mark").over(order) - 1).cast("int")).drop("_mark")


def first_numbers(doc_pages: DataFrame, group: str, first: int = 1) -> DataFrame:
    """doc_pages (group, doc_id, n_pages) with the running number of each document's first page in its set."""
    found = running(doc_pages, [group], ["doc_id"], {"_before": F.col("n_pages")})
    return found.withColumn("first_number", (F.col("_before") + first).cast("long")).drop("_before", "nth")


def numbered_pages(doc_pages: DataFrame, group: str, prefix: str, digits: int, suffix: str = "") -> DataFrame:
    """One row a page with its running label over the set."""
    spread = first_numbers(doc_pages, group).withColumn("page_no", F.explode(F.sequence(F.lit(1), F.col("n_pages").cast("int"))))
    number = F.col("first_number") + F.col("page_no") - 1
    return spread.select(group, "doc_id", "page_no", T.running_label(prefix, number, digits, suffix).alias("label"))


def page_labels(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """pages with the latest label run at or before each: runs (doc_id, page_no, style, first)."""
    order = Window.partitionBy("doc_id").orderBy("page_no")
    known = pages.join(runs, ["doc_id", "page_no"], "left").withColumn("_start", F.when(F.col("style").isNotNull(), F.col("page_no")))
    for name in ("style", "first", "_start"):
        known = known.withColumn(name, F.last(name, ignorenulls=True).over(order))
    number = (F.col("first") + F.col("page_no") - F.col("_start")).cast("int")
    label = F.when(F.col("style") == "roman", T.roman(number)).when(F.col("style") == "letters", T.alphabetic(number)).otherwise(F.coalesce(number, F.col("page_no")).cast("string"))
    return known.withColumn("label", label).drop("_start")


def merged(parts: DataFrame, order: list[str], group: str) -> DataFrame:
    """parts in one document a group: page_no is the position in the ordered concatenation."""
    return running(parts, [group], order).withColumn("merged_page", F.col("nth").cast("int")).drop("nth")


def unique_names(fields: DataFrame, group: str, name: str, order: list[str]) -> DataFrame:
    """fields with unique_name: a repeated name gets ' (2)', ' (3)' in order; a missing one becomes Field and its number."""
    blank = F.coalesce(F.trim(name), F.lit("")) == ""
    keyed = running(fields.withColumn("_name", F.when(blank, "").otherwise(F.col(name))), [group, "_name"], order)
    nth = F.col("nth")
    return keyed.withColumn("unique_name", F.when(blank, F.concat(F.lit("Field"), nth.cast("string"))).when(nth == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), nth.cast("string"), F.lit(")")))).drop("_name", "nth")


def moved(pages: DataFrame, source: int, target: int) -> DataFrame:
    """pages with page_no after page `source` moves to position `target`; documents without that page stay."""
    p = F.col("page_no")
    last = F.max("page_no").over(Window.partitionBy("doc_id"))
    to = F.least(F.lit(target), last)
    shifted = F.when(p == source, to).when((p > source) & (p <= to), p - 1).when((p < source) & (p >= to), p + 1).otherwise(p)
    return pages.withColumn("new_page_no", F.when(last >= source, shifted).otherwise(p).cast("int"))


PageEdit = tuple[str, int] | tuple[str, int, int]


def edited(documents: DataFrame, edits: list[PageEdit]) -> DataFrame:
    """(doc_id, page_no, source_page, rotation) of documents (doc_id, n_pages) after edits in order, each on what the edits before have left.

    ("remove", n), ("insert", n): a blank page before page n, or behind the last for one more, ("move", n, to), ("rotate", n, degrees): added to the page's, in 0 to 270. An edit of a
    page that a document does not have leaves it as it is, so does one that would remove its only page. A blank page's source is null. Pages stay in their document's row
    until the end; documents without pages have no rows.
    """
    page = "struct<source:int,rotation:int>"
    state = F.transform(F.sequence(F.lit(1), F.col("n_pages").cast("int")), lambda p: F.struct(p.alias("source"), F.lit(0).alias("rotation")))
    blank = F.array(F.struct(F.lit(None).cast("int").alias("source"), F.lit(0).alias("rotation")).cast(page))
    rows = documents.where("n_pages > 0").select("doc_id", state.cast(f"array<{page}>").alias("_p"))
    for kind, n, *rest in edits:
        p, size = F.col("_p"), F.size("_p")
        before, after = F.slice(p, F.lit(1), F.lit(max(n - 1, 0))), F.slice(p, F.lit(max(n + 1, 1)), size)
        there = (size >= n) & F.lit(n >= 1)
        if kind == "remove":
            new, able = F.concat(before, after), there & (size > 1)
        elif kind == "insert":
            new, able = F.concat(before, blank, F.slice(p, F.lit(max(n, 1)), size)), (size >= n - 1) & F.lit(n >= 1)
        elif kind == "move":
            (to,) = rest
            left = F.concat(before, after)
            new, able = F.concat(F.slice(left, F.lit(1), F.lit(max(to - 1, 0))), F.array(F.get(p, F.lit(n - 1))), F.slice(left, F.lit(max(to, 1)), size)), there & (size >= to) & F.lit(to >= 1)
        elif kind == "rotate":
            (degrees,) = rest
            new, able = _rotated(p, n, degrees), there
        else:
            raise ValueError(f"unknown edit {kind}")
        rows = rows.withColumn("_p", F.when(able, new).otherwise(p))
    return rows.select("doc_id", F.posexplode("_p").alias("at", "x")).select("doc_id", (F.col("at") + 1).alias("page_no"), F.col("x.source").alias("source_page"), F.col("x.rotation").alias("rotation"))


def _rotated(pages: Column, n: int, degrees: int) -> Column:
    turned = lambda x: F.struct(x["source"].alias("source"), F.pmod(x["rotation"] + degrees, F.lit(360)).cast("int").alias("rotation"))
    return F.transform(pages, lambda x, i: F.when(i == n - 1, turned(x)).otherwise(x))


def page_selection(pages: DataFrame, mode: str) -> DataFrame:
    """First: page 1. Sample: pages 1, 2, 5 and 20 where they exist. All: every page."""
    if mode == "First":
        return pages.where("page_no = 1")
    if mode == "Sample":
        return pages.where(F.col("page_no").isin(1, 2, 5, 20))
    if mode == "All":
        return pages
    raise ValueError(f"unknown mode {mode}")
