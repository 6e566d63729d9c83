"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.where("a < b").unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id that has a link to another; component is the smallest id that links reach.

    Links to itself and with a null end are ignored. Each round's links are written to the shared folder; there are about as
    many rounds as the logarithm of the longest path. A node with many links is split by the adaptive skew join.
    """
    now = edges.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("a < b").distinct()
    now, seen = stored(now), None
    while True:
        # Stars only: no node is a child of two, none is both child and parent.
        children, parents = now.groupBy("b").count(), now.select(F.col("a").alias("b")).distinct()
        bad = children.where("count > 1").select("b").unionByName(children.select("b").join(parents, "b", "left_semi")).limit(1)
        if bad.isEmpty():
            break
        now = stored(_small_star(_large_star(now)))
        summed = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if summed == seen:
            break
        seen = summed
    child = now.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return child.unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
