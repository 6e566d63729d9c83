"""Adapter: HTML pages as drawing operators and as objects with references, natively from the markup.

A tag opens an object nested in those that are open before it, its end tag closes the last one; ends may be missing or too many. Drawn, an
opened element saves the graphics state and moves, turns or scales the page, an end tag restores it, text is shown in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = r"<[^>]*>|[^<]+"
#: By element the matrix that it puts before the current one; others move by (4, -4).
MATRICES = {"div": (1, 0, 0, 1, 16, -8), "p": (1, 0, 0, 1, 0, -12), "b": (0, 1, -1, 0, 8, 8), "ul": (2, 0, 0, 2, 0, 0), "h1": (1.5, 0, 0, 1.5, 0, 0), "footer": (1, 0.5, 0, 1, 0, 0)}
OTHERS = (1, 0, 0, 1, 4, -4)
#: Elements that fill a box (x, y, width, height) with a colour when they open, and the operator that sets it.
FILLS = {"h1": ("rg", (0.5, 0.25, 0.0), (0, -4, 240, 24)), "br": ("k", (0.0, 0.0, 0.0, 1.0), (0, -16, 400, 64)), "footer": ("g", (1.0,), (0, 0, 400, 40)), "article": ("g", (0.25,), (0, -40, 60, 60))}
_OP = "struct<name:string,operands:array<double>,text:string,image:boolean>"


def pieces(pages: DataFrame) -> DataFrame:
    """(page_id, piece_no, piece): tags and texts of each page in order; a null page has none."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(PIECE), F.lit(0))).alias("piece_no", "piece"))


def _op(name: str, operands: Column | None = None, text: Column | None = None, image: bool = False) -> Column:
    return F.struct(F.lit(name).alias("name"), (F.array().cast("array<double>") if operands is None else operands).alias("operands"), (F.lit(None).cast("string") if text is None else text).alias("text"), F.lit(image).alias("image"))


def _numbers(values: tuple[float, ...]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _opened(tag: Column) -> Column:
    """The operators of an opened element: q, cm and, for some, a filled box; br, meta and img open nothing."""
    matrix = _numbers(OTHERS)
    for name, values in MATRICES.items():
        matrix = F.when(tag == name, _numbers(values)).otherwise(matrix)
    moved = F.array(_op("q"), _op("cm", matrix))
    filled = F.array().cast(f"array<{_OP}>")
    for name, (colour, values, box) in FILLS.items():
        filled = F.when(tag == name, F.array(_op(colour, _numbers(values)), _op("re", _numbers(box)), _op("f"))).otherwise(filled)
    return F.when(tag == "meta", F.array(_op("BI"))).when(tag == "img", F.array(_op("Do", image=True))).when(tag == "br", filled).otherwise(F.concat(moved, filled))


def page_operators(pages: DataFrame) -> DataFrame:
    """(page_id, ops): the drawing operators of each page as an array of (name, operands, text, image) in order.

    A text's operands are its box in text space: 6 a letter wide, 10 high.
    """

    def drawn(piece: Column) -> Column:
        tag = F.regexp_extract(piece, r"^</?([a-z][a-z0-9]*)", 1)
        shown = F.array(_op("Tj", F.array(F.lit(0.0), F.lit(0.0), F.length(piece) * 6.0, F.lit(10.0)), piece))
        nothing = F.array().cast(f"array<{_OP}>")
        return F.when(~F.startswith(piece, F.lit("<")), shown).when(tag == "", nothing).when(F.startswith(piece, F.lit("</")), F.array(_op("Q"))).otherwise(_opened(tag))

    return pages.select("page_id", F.flatten(F.transform(F.regexp_extract_all("html", F.lit(PIECE), F.lit(0)), drawn)).alias("ops"))


def objects(pages: DataFrame) -> DataFrame:
    """(page_id, object_no, tag, level, parent_no): each opened element as an object and the one that it is nested in, null for the outermost.

    level is how many elements are open before it: opened less closed ones, so an element without an end holds all that follow it. The
    windows are over one page each.
    """
    tag = F.regexp_extract("piece", r"^</?([a-z][a-z0-9]*)", 1)
    closes = F.startswith("piece", F.lit("</"))
    tags = pieces(pages).withColumn("tag", tag).where("tag <> ''").withColumn("_step", F.when(closes, -1).otherwise(1))
    order = Window.partitionBy("page_id").orderBy("piece_no")
    opened = tags.withColumn("level", F.sum("_step").over(order).cast("int")).where("_step = 1").withColumn("level", F.col("level") - 1)
    opened = opened.select("page_id", F.col("piece_no").alias("object_no"), "tag", "level")
    # The parent is the last object opened before at one level less: both stand in one group by level, in page order.
    here, inner = F.struct(F.col("level").alias("k"), F.col("object_no").alias("outer_no")), F.struct((F.col("level") - 1).alias("k"), F.lit(None).cast("int").alias("outer_no"))
    both = opened.withColumn("_as", F.explode(F.array(here, inner))).withColumn("_own", F.col("_as.outer_no").isNull())
    up = Window.partitionBy("page_id", "_as.k").orderBy("object_no").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("parent_no", F.last("_as.outer_no", ignorenulls=True).over(up)).where("_own").select("page_id", "object_no", "tag", "level", "parent_no")


def references(found: DataFrame) -> DataFrame:
    """(page_id, source, target): each object refers to those nested in it and each of those back to it, as page trees do."""
    nested = found.where("parent_no is not null")
    return nested.select("page_id", F.col("parent_no").alias("source"), F.col("object_no").alias("target")).unionByName(nested.select("page_id", F.col("object_no").alias("source"), F.col("parent_no").alias("target")))


def with_places(found: DataFrame) -> DataFrame:
    """objects with place: 1, 2, ... among those of the same parent, in page order."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy("page_id", "parent_no").orderBy("object_no")))
