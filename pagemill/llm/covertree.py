"""Exact near-duplicate vectors by a dual traversal of a cover tree, spread over Spark.

Unit vectors with cosine >= c are within t = sqrt(2 - 2c) of each other. A cover tree with halving radii is built over at most
`pivots` vectors (those with the smallest hash of their id); its leaves are bounded, so it goes to every task. Each vector of the table
goes to its nearest leaf, the true covering radii come back (one number a leaf) and the dual traversal drops node pairs whose
centres are farther apart than both radii and t allow. Surviving leaf pairs are compared in blocks of bounded size, whole, in double
precision; tasks give counts and spanning links of what they find, never pairs. Equal vectors are one representative from the start.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import stored
from pagemill.llm.components import connected_components


#: About so many blocks of vectors, unless they would take more bytes than this in double precision.
BLOCKS, BLOCK_BYTES = 16, 64 << 20


@dataclass
class Tree:
    """Nodes level by level: centre, parent, and whether a node is a leaf; leaf nodes have consecutive `leaf` numbers in tree order."""

    centres: np.ndarray
    parent: np.ndarray
    children: list[list[int]]
    leaves: list[int]


def build_tree(points: np.ndarray, least: float) -> Tree:
    """Nested levels: a level's centres are farther apart than its radius and each point is within it of a centre; radii halve
    from 2 (the diameter of the sphere) until they reach `least`. Every centre stays a centre on the levels below."""
    nodes, parent, children = [0], [-1], [[]]
    level, radius = [(0, np.arange(len(points)))], 2.0
    while level and radius > least:
        radius /= 2
        below = []
        for node, own in level:
            # The node's own point first, then greedily any point that no centre covers.
            free = own[own != nodes[node]]
            groups = [(nodes[node], [nodes[node]])]
            near = np.linalg.norm(points[free] - points[nodes[node]], axis=1) if len(free) else np.zeros(0)
            owner = np.zeros(len(free), int)
            while len(free) and near.max() > radius:
                pick = int(near.argmax())
                groups.append((free[pick], []))
                d = np.linalg.norm(points[free] - points[free[pick]], axis=1)
                closer = d < near
                near, owner = np.where(closer, d, near), np.where(closer, len(groups) - 1, owner)
            for g, (centre, _) in enumerate(groups):
                mine = np.unique(np.append(free[owner == g], centre))
                nodes.append(centre)
                parent.append(node)
                children.append([])
                children[node].append(len(nodes) - 1)
                if len(mine) > 1:
                    below.append((len(nodes) - 1, mine))
        level = below
    leaves: list[int] = []
    stack = [0]
    while stack:
        node = stack.pop()
        if children[node]:
            stack.extend(reversed(children[node]))
        else:
            leaves.append(node)
    return Tree(points[nodes], np.array(parent), children, leaves)


def node_radii(tree: Tree, leaf_radius: np.ndarray) -> np.ndarray:
    """Covering radius of every node: its leaves' true radii, carried up by the distances between centres; -1 without points."""
    radius = np.full(len(tree.parent), -1.0)
    radius[tree.leaves] = leaf_radius
    for node in range(len(tree.parent) - 1, 0, -1):
        if radius[node] >= 0:
            up = tree.parent[node]
            radius[up] = max(radius[up], radius[node] + np.linalg.norm(tree.centres[up] - tree.centres[node]))
    return radius


def near_leaves(tree: Tree, radius: np.ndarray, reach: float) -> np.ndarray:
    """Dual traversal: which leaf pairs may hold points within reach, as a symmetric matrix over leaf numbers."""
    number = {node: i for i, node in enumerate(tree.leaves)}
    out = np.zeros((len(tree.leaves),) * 2, bool)
    stack = [(0, 0)]
    while stack:
        a, b = stack.pop()
        if radius[a] < 0 or radius[b] < 0 or np.linalg.norm(tree.centres[a] - tree.centres[b]) > radius[a] + radius[b] + reach + 1e-9:
            continue
        if not tree.children[a] and not tree.children[b]:
            out[number[a], number[b]] = out[number[b], number[a]] = True
        elif a == b:
            own = tree.children[a]
            stack.extend((own[i], own[j]) for i in range(len(own)) for j in range(i, len(own)))
        elif tree.children[a] and (radius[a] >= radius[b] or not tree.children[b]):
            stack.extend((c, b) for c in tree.children[a])
        else:
            stack.extend((a, c) for c in tree.children[b])
    return out


def _unit(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of unit length in double precision; shorter vectors are padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    sizes = np.diff(lists.offsets.to_numpy())
    x = np.zeros((len(sizes), dims))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    x[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its component) for the links a-b, found by propagating labels."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = place[: len(a)], place[len(a) :]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def _runs(places: np.ndarray, most: int) -> list[np.ndarray]:
    return [places[s : s + most] for s in range(0, len(places), most)]


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = 512, block_rows: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for every row of vectors.

    Null vectors, zero vectors and those with null or non-finite components link with nothing, nor do rows with a null id (their component
    is null, they are kept). Vectors of different lengths are compared as if padded with zeros. Rows that repeat an id are vectors of
    their own. Other columns are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    # Single precision travels as it is; what is computed is double.
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("x"))
    good = F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.coalesce(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False)) & F.coalesce(F.exists("x", lambda v: v != 0), F.lit(False))
    rows = stored(given.withColumn("good", good))
    reps = stored(rows.where("good").groupBy("x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")))
    dims = reps.agg(F.max(F.size("x"))).first()[0]
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), "good")
    if dims is None:
        return alone.drop("good")
    reach = math.sqrt(max(2 - 2 * cosine, 0.0))
    sample = reps.select("x").orderBy(F.xxhash64("x"), "rep").limit(pivots).toArrow()
    tree = build_tree(_unit(sample.column("x"), dims), reach / 4)
    centres = tree.centres[tree.leaves]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                x = _unit(part.column("x"), dims)
                cos = x @ centres.T
                leaf = cos.argmax(axis=1)
                distance = np.linalg.norm(x - centres[leaf], axis=1)
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("weight"), pa.array(leaf.astype(np.int32)), pa.array(distance), part.column("x")], names=["rep", "weight", "leaf", "distance", "x"])

    placed = stored(reps.select("rep", "weight", "x").mapInArrow(place, f"rep long, weight long, leaf int, distance double, x {kind}"))
    stats = {r.leaf: r for r in placed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()}
    radius = np.array([stats[i].radius if i in stats else -1.0 for i in range(len(tree.leaves))])
    near = near_leaves(tree, node_radii(tree, radius), reach)
    # Blocks: runs of leaves in tree order of about block_rows vectors; a larger leaf is dealt by hash over blocks of its own. A block goes to each block that it meets, so
    # in a larger table blocks grow, up to BLOCK_BYTES, instead of the times that a vector travels.
    block_rows = max(block_rows, min(-(-sum(r.n for r in stats.values()) // BLOCKS), BLOCK_BYTES // (8 * max(dims, 1))))
    places, block, filled = [], -1, block_rows
    for leaf in range(len(tree.leaves)):
        n = stats[leaf].n if leaf in stats else 0
        if n > block_rows:
            parts = -(-n // block_rows)
            places.append((leaf, block + 1, parts))
            block, filled = block + parts, block_rows
        elif n:
            if filled + n > block_rows:
                block, filled = block + 1, 0
            places.append((leaf, block, 1))
            filled += n
    of = spark.createDataFrame(places, "leaf int, first int, parts int")
    blocks = placed.join(F.broadcast(of), "leaf").withColumn("block", F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    blocks = stored(blocks.groupBy("block").agg(F.collect_list(F.struct("rep", "weight", "leaf", "x")).alias("rows")))
    # At most half of pivots**2 leaf pairs come from the driver; the block pairs, whose number grows with the table, are made in Spark.
    first, parts = np.zeros(len(tree.leaves), int), np.zeros(len(tree.leaves), int)
    for leaf, at, n in places:
        first[leaf], parts[leaf] = at, n
    close = np.argwhere(np.triu(near) & (parts[:, None] > 0) & (parts[None, :] > 0))
    met = spark.createDataFrame(pa.table({name: pa.array(column) for name, column in zip(("f1", "p1", "f2", "p2"), (first[close[:, 0]], parts[close[:, 0]], first[close[:, 1]], parts[close[:, 1]]), strict=True)})).repartition("f1", "f2")
    met = met.withColumn("x", F.explode(F.sequence(F.col("f1"), F.col("f1") + F.col("p1") - 1))).withColumn("y", F.explode(F.sequence(F.col("f2"), F.col("f2") + F.col("p2") - 1)))
    pairs = met.select(F.least("x", "y").cast("int").alias("b1"), F.greatest("x", "y").cast("int").alias("b2")).distinct()
    both = pairs.join(blocks.select(F.col("block").alias("b1"), F.col("rows").alias("one")), "b1").join(blocks.select(F.col("block").alias("b2"), F.col("rows").alias("two")), "b2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one, two = batch.column("one")[row].values, batch.column("two")[row].values
                same = batch.column("b1")[row].as_py() == batch.column("b2")[row].as_py()
                x, y = _unit(one.field("x"), dims), _unit(two.field("x"), dims)
                r1, r2 = one.field("rep").to_numpy(), two.field("rep").to_numpy()
                w1, w2 = one.field("weight").to_numpy(), two.field("weight").to_numpy()
                l1, l2 = one.field("leaf").to_numpy(), two.field("leaf").to_numpy()
                n1, n2, at, to = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), [], []
                for leaf in np.unique(l1):
                    own, others = np.flatnonzero(l1 == leaf), np.flatnonzero(near[leaf, l2])
                    for i, j in itertools.product(_runs(own, 2048), _runs(others, 2048)):
                        linked = x[i] @ y[j].T >= cosine
                        if same:
                            linked &= i[:, None] != j[None, :]
                        a, b = np.nonzero(linked)
                        if not len(a):
                            continue
                        n1[i] += linked @ w2[j]
                        if not same:
                            n2[j] += w1[i] @ linked
                        # Links that span the same components as all found here.
                        ids, least = _spanning(r1[i[a]], r2[j[b]])
                        at.append(ids)
                        to.append(least)
                ids, least = _spanning(np.concatenate(at), np.concatenate(to)) if at else (np.zeros(0, np.int64),) * 2
                linked1, linked2 = n1 > 0, n2 > 0
                rep = np.concatenate([r1[linked1], r2[linked2], ids])
                count = np.concatenate([n1[linked1], n2[linked2], np.zeros(len(ids), np.int64)])
                link = np.concatenate([r1[linked1], r2[linked2], least])
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(count), pa.array(link)], names=["rep", "n", "link"])

    found = stored(both.mapInArrow(compare, "rep long, n long, link long"))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    components = connected_components(found.where("rep != link").select("rep", "link"), "rep", "link").withColumnRenamed("id", "rep")
    whole = reps.join(counts, "rep", "left").join(components, "rep", "left").select("x", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = rows.where("good").join(whole, "x").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(alone.where("not good").drop("good"))
