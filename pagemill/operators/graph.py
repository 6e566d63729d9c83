"""Traversals of objects that refer to each other: reachability with a depth limit, and outlines in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.storage import stored

#: Fixed value: outlines nested deeper than this are not followed.
MAX_DEPTH = 32


def reachable(roots: DataFrame, edges: DataFrame, keys: list[str], max_depth: int = MAX_DEPTH) -> DataFrame:
    """(keys, node, depth): the nodes that one gets to from roots (keys, node) over edges (keys, source, target), with the fewest steps.

    Goes from frontier to frontier: each round joins the nodes found last with the edges, drops those seen before (so cycles end) and is stored.
    Rounds end when nothing new is found or at max_depth. Roots need no edges; null nodes are dropped; repeated roots and edges count once.
    """
    links = stored(edges.where("source is not null and target is not null").select(*keys, "source", "target").distinct())
    frontier = stored(roots.where("node is not null").select(*keys, "node").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for depth in range(1, max_depth + 1):
        step = frontier.join(links, [*(frontier[k].eqNullSafe(links[k]) for k in keys), frontier["node"] == links["source"]]).select(*(links[k] for k in keys), links["target"].alias("node")).distinct()
        known = seen.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("node").alias("_node"))
        fresh = step.join(known, [*(step[k].eqNullSafe(known[f"_{k}"]) for k in keys), step["node"] == known["_node"]], "left_anti")
        frontier = stored(fresh.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def outline(items: DataFrame, keys: list[str], max_depth: int = MAX_DEPTH) -> DataFrame:
    """items (keys, node, parent, place, ...) as an outline: depth and path, the places from the top down to the item, whose order is reading order.

    Items whose parent is null stand at depth 0. An item is taken over its parents level by level, up to max_depth; what no chain of parents
    joins to the top (cycles, lost parents) is not part of the outline. An item with several rows for one place in the tree is a row each.
    """
    given = stored(items)
    level = stored(given.where("parent is null").withColumn("depth", F.lit(0)).withColumn("path", F.array("place")))
    found = level
    for depth in range(1, max_depth + 1):
        above = level.select(*keys, F.col("node").alias("parent"), F.col("path").alias("_above")).dropDuplicates([*keys, "parent"])
        level = stored(given.join(above, [*keys, "parent"]).withColumn("depth", F.lit(depth)).withColumn("path", F.concat("_above", F.array("place"))).drop("_above").select(*found.columns))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found
