"""Joins of rectangles by a grid with levels, so that only boxes that are near each other meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import geometry as G

#: Sides of boxes are told apart by powers of two between these; smaller and larger ones go with the outermost.
LOWEST, HIGHEST = -4, 40


def _level(box: Column) -> Column:
    """The least power of two that is no shorter than the box's longer side: at that cell size a box touches at most 2 x 2 cells."""
    side = F.greatest(box["r"] - box["l"], box["t"] - box["b"], F.lit(2.0**LOWEST))
    return F.least(F.ceil(F.log2(side)), F.lit(HIGHEST)).cast("int")


def _cell(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), level)).cast("long")


def _dealt(items: DataFrame, keys: list[str], box: str, levels: Column) -> DataFrame:
    """A row for each cell that a box touches, at its own level (home) and at the coarser ones among `levels`."""
    own = _level(F.col(box))
    at = items.withColumn("_home", own).withColumn("_level", F.explode(F.array_union(F.array(own), F.filter(levels, lambda v: v > own))))
    for axis, low, high in (("_x", "l", "r"), ("_y", "b", "t")):
        cells = F.sequence(_cell(F.col(box)[low], F.col("_level")), _cell(F.col(box)[high], F.col("_level")))
        at = at.withColumn(axis, F.explode(cells))
    return at.withColumn("_home", F.col("_home") == F.col("_level"))


def _levels(left: DataFrame, right: DataFrame, left_box: str, right_box: str) -> tuple[Column, Column]:
    """The levels that each side uses, at most HIGHEST - LOWEST + 1 numbers a side, found in one job."""
    both = left.select(F.lit(0).alias("side"), _level(F.col(left_box)).alias("v")).unionByName(right.select(F.lit(1).alias("side"), _level(F.col(right_box)).alias("v")))
    found = both.distinct().collect()
    listed = [F.array(*(F.lit(r.v) for r in found if r.side == side)) if any(r.side == side for r in found) else F.array().cast("array<int>") for side in (0, 1)]
    return listed[0], listed[1]


def crossing_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_box: str, right_box: str) -> DataFrame:
    """All pairs of rows with equal keys whose boxes cross (strictly, as G.intersects), each once; columns of both sides, those of keys once.

    Boxes must be normalised. A box stands in the 1 to 4 cells that it touches at its own level, and at the coarser levels that the
    other side has, so a pair meets at the coarser of its two levels; of the cells that both touch only the one with the lower left corner of their
    intersection counts. Rows that meet are therefore near each other, whatever else is on a page. Boxes that are null join nothing; the
    other columns of the two sides must have different names.
    """
    a, b = left.where(F.col(left_box).isNotNull()), right.where(F.col(right_box).isNotNull())
    in_left, in_right = _levels(a, b, left_box, right_box)
    a, b = _dealt(a, keys, left_box, in_right), _dealt(b, keys, right_box, in_left)
    b = b.withColumnRenamed("_home", "_home_right")
    x, y = F.col(left_box), F.col(right_box)
    met = a.join(b, [*keys, "_level", "_x", "_y"]).where((F.col("_home") | F.col("_home_right")) & G.intersects(x, y))
    first = (F.col("_x") == _cell(F.greatest(x["l"], y["l"]), F.col("_level"))) & (F.col("_y") == _cell(F.greatest(x["b"], y["b"]), F.col("_level")))
    return met.where(first).drop("_level", "_x", "_y", "_home", "_home_right")
