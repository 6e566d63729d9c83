"""Content operators of pages as rows (doc_id, page_no, op_idx, name, category, box, text): filters, edits and redaction marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.operators.redact import without_intersecting
from pagemill.sources.layout import text_lines

#: Content operators of the page description format by category; any other name is Unknown.
CATEGORIES = {
    "GraphicsState": "q Q cm w J j M d ri i gs",
    "PathConstruction": "m l c v y h re",
    "PathPainting": "S s f F f* B B* b b* n",
    "Clipping": "W W*",
    "TextState": "Tc Tw Tz TL Tf Tr Ts",
    "TextPositioning": "Td TD Tm T*",
    "TextShowing": "Tj TJ ' \"",
    "TextObject": "BT ET",
    "Color": "CS cs SC SCN sc scn G g RG rg K k",
    "Shading": "sh",
    "XObject": "BI ID EI Do",
    "MarkedContent": "MP DP BMC BDC EMC",
    "Compatibility": "BX EX",
}
MARKER = ("q", "rg", "re", "f", "Q")


def category(name: Column) -> Column:
    found = F.lit("Unknown")
    for kind, names in CATEGORIES.items():
        found = F.when(name.isin(*names.split()), kind).otherwise(found)
    return found


def layout_operators(docs: DataFrame) -> DataFrame:
    """The operators that would draw each line of the layout adapter: BT, Tf, Td, Tj, ET; only Tj has a box and text."""
    lines = text_lines(docs).where("length(text) > 0")
    box = G.rect(F.lit(72), 720 - 12 * F.col("row"), 72 + 6 * F.length("text"), 730 - 12 * F.col("row"))
    drawn = lines.select("doc_id", "page_no", "row", box.alias("_box"), F.col("text").alias("_text"), F.posexplode(F.array(*map(F.lit, ("BT", "Tf", "Td", "Tj", "ET")))).alias("_k", "name"))
    shown = F.col("name") == "Tj"
    return drawn.select("doc_id", "page_no", (F.col("row") * 5 + F.col("_k")).alias("op_idx"), "name", category(F.col("name")).alias("category"), F.when(shown, F.col("_box")).alias("box"), F.when(shown, F.col("_text")).alias("text"))


def of_category(ops: DataFrame, *kinds: str) -> DataFrame:
    return ops.where(F.col("category").isin(*kinds))


def without_category(ops: DataFrame, kind: str) -> DataFrame:
    return ops.where(F.col("category") != kind)


def showing(ops: DataFrame, needle: str, ignore_case: bool = False) -> DataFrame:
    """Text-showing operators whose text contains the needle."""
    text = F.lower("text") if ignore_case else F.col("text")
    return of_category(ops, "TextShowing").where(F.contains(text, F.lit(needle.lower() if ignore_case else needle)))


def renumbered(ops: DataFrame) -> DataFrame:
    """ops with op_idx as their place (from 0) in the page."""
    return ops.withColumn("op_idx", (F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("op_idx")) - 1).cast("int"))


def redacted(ops: DataFrame, area: Column, mark: bool = True) -> DataFrame:
    """ops without those that cross the area, then, for every page, the five operators that paint it over."""
    kept = without_intersecting(ops, area)
    if not mark:
        return kept
    last = ops.groupBy("doc_id", "page_no").agg((F.max("op_idx") + 1).alias("_next"))
    marks = last.select("doc_id", "page_no", "_next", F.posexplode(F.array(*map(F.lit, MARKER))).alias("_k", "name"))
    painted = marks.select("doc_id", "page_no", (F.col("_next") + F.col("_k")).alias("op_idx"), "name", category(F.col("name")).alias("category"), F.when(F.col("name") == "re", area).alias("box"), F.lit(None).cast("string").alias("text"))
    return renumbered(kept.unionByName(painted))
