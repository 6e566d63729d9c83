"""Rectangles as structs (l, b, r, t) of doubles, and predicates on them as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(left: Column, bottom: Column, right: Column, top: Column) -> Column:
    return F.struct(left.cast("double").alias("l"), bottom.cast("double").alias("b"), right.cast("double").alias("r"), top.cast("double").alias("t"))


def normalised(x: Column) -> Column:
    return rect(F.least(x["l"], x["r"]), F.least(x["b"], x["t"]), F.greatest(x["l"], x["r"]), F.greatest(x["b"], x["t"]))


def intersects(x: Column, y: Column) -> Column:
    """Strict: touching edges do not count. False when either is null."""
    return F.coalesce((x["l"] < y["r"]) & (x["r"] > y["l"]) & (x["b"] < y["t"]) & (x["t"] > y["b"]), F.lit(False))


def has_point(x: Column, px: Column, py: Column) -> Column:
    """Closed: edges belong to the rectangle."""
    return F.coalesce((px >= x["l"]) & (px <= x["r"]) & (py >= x["b"]) & (py <= x["t"]), F.lit(False))


def contains(outer: Column, inner: Column) -> Column:
    return has_point(outer, inner["l"], inner["b"]) & has_point(outer, inner["r"], inner["t"])


def overlap_type(box: Column, area: Column) -> Column:
    return F.when(contains(area, box), "Full").when(intersects(area, box), "Partial").otherwise("None")


def removed(box: Column, area: Column, strategy: str) -> Column:
    """Whether a glyph box goes: AnyOverlap, FullyContained or CenterPoint."""
    if strategy == "AnyOverlap":
        return intersects(area, box)
    if strategy == "FullyContained":
        return contains(area, box)
    if strategy == "CenterPoint":
        return has_point(area, (box["l"] + box["r"]) / 2, (box["b"] + box["t"]) / 2)
    raise ValueError(f"unknown strategy {strategy}")


def cover_share(box: Column, cover: Column) -> Column:
    """Share of a box's area that another box covers."""
    w = F.greatest(F.least(box["r"], cover["r"]) - F.greatest(box["l"], cover["l"]), F.lit(0.0))
    h = F.greatest(F.least(box["t"], cover["t"]) - F.greatest(box["b"], cover["b"]), F.lit(0.0))
    return w * h / F.greatest((box["r"] - box["l"]) * (box["t"] - box["b"]), F.lit(1e-6))


def bounding(x: str) -> Column:
    """Aggregate: the smallest rectangle around those of column x."""
    return rect(F.min(f"{x}.l"), F.min(f"{x}.b"), F.max(f"{x}.r"), F.max(f"{x}.t"))


def transformed(x: Column, a: float, b: float, c: float, d: float, e: float, f: float) -> Column:
    """Bounding box of a rectangle under the affine map (x, y) -> (ax + cy + e, bx + dy + f)."""
    corners = [(x[i], x[j]) for i in ("l", "r") for j in ("b", "t")]
    xs = [p * a + q * c + e for p, q in corners]
    ys = [p * b + q * d + f for p, q in corners]
    return rect(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def hidden_colour(red: Column, green: Column, blue: Column) -> Column:
    """An opaque fill hides text unless it is all but white."""
    return ~((red >= 0.95) & (green >= 0.95) & (blue >= 0.95))
