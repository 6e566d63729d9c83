"""MinHash near-duplicates by tensored banding, with every link confirmed on the full shingle sets.

A document gets `collections` short sketches of `width` minimum hashes each. Table keys are pairs of those sketches, so
collections*width hashes serve collections*(collections-1)/2 tables of 2*width hashes: with 12 collections of 3, 36 hashes
serve 66 tables. Two documents with similarity J meet in a table when at least two of their sketches agree; at J = 0.8
(agreement 0.8**3 a sketch) that fails for 1 pair in 400, at 0.85 for 1 in 5,000.

Copies with the same shingle set are one representative before any key is made. Within a bucket no pairs are expanded: every
member is tested against a centre, linked ones become one component, and only buckets that still hold two components go on:
with another centre, and in the end in blocks of bounded size, where every pair across components is compared in a task and only links leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import keyed, mix, shingle_sets, stored, text_chunks
from pagemill.llm.components import connected_components

SKETCH = "doc_id long, doc long, n long, f1 long, f2 long, halves array<long>"


def _sketcher(k: int, collections: int, width: int):
    seeds = mix(np.arange(1, 2 * collections * width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    xors, factors = seeds[::2], seeds[1::2] | np.uint64(1)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, doc = batch.column("doc_id"), batch.column("doc")
            for lo, hi, data, offsets in text_chunks(batch.column("text")):
                sets = shingle_sets(data, offsets, k)
                sizes = np.array([len(s) for s in sets], np.int64)
                f1, f2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                halves = np.zeros((len(sets), collections), np.uint64)
                full = np.flatnonzero(sizes)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    f1[full] = np.add.reduceat(flat, at)
                    f2[full] = np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), at)
                    for c in range(collections):
                        part = np.zeros(len(full), np.uint64)
                        for w in range(c * width, (c + 1) * width):
                            part = mix(part ^ np.minimum.reduceat((flat ^ xors[w]) * factors[w], at))
                        halves[full, c] = part
                lists = pa.ListArray.from_arrays(np.arange(0, halves.size + 1, collections, dtype=np.int32), halves.reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), doc.slice(lo, hi - lo), pa.array(sizes), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists], names=["doc_id", "doc", "n", "f1", "f2", "halves"])

    return sketch


def _confirm(k: int, percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                sides = []
                for name in ("text_a", "text_b"):
                    sides.append([s for _, _, data, offsets in text_chunks(part.column(name)) for s in shingle_sets(data, offsets, k)])
                keep = []
                for x, y in zip(*sides, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _star_pairs(members: DataFrame, round_no: int) -> DataFrame:
    """Pairs (a < b) of a bucket's centre with each member in another component; the centre changes with the round."""
    mixed = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    left = members.join(mixed, "key")
    order = F.struct((F.xxhash64("rep", "key", F.lit(round_no)) * F.lit(min(round_no, 1))).alias("o"), F.col("rep"), F.col("n"), F.col("component"))
    centre = left.groupBy("key").agg(F.min(order).alias("c")).select("key", F.col("c.rep").alias("rep2"), F.col("c.n").alias("n2"), F.col("c.component").alias("component2"))
    return left.join(centre, "key").where("component != component2").select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b"), "n", "n2")


def _compare_blocks(k: int, percent: int):
    def sets_of(side: pa.Array) -> list[np.ndarray]:
        return [s for _, _, data, offsets in text_chunks(side.field("text")) for s in shingle_sets(data, offsets, k)]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links across components within a pair of blocks; of each document's links, the ones to other components' first."""
        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column("same")[row].as_py()
                one = batch.column("one")[row].values
                two = one if same else batch.column("two")[row].values
                x, y = sets_of(one), None if same else sets_of(two)
                y = x if same else y
                flat = np.concatenate(x if same else x + y)
                doc = np.repeat(np.arange(len(x) if same else len(x) + len(y)), [len(s) for s in (x if same else x + y)])
                values, column, count = np.unique(flat, return_inverse=True, return_counts=True)
                use = count[column] > 1
                doc, column = doc[use], np.cumsum(count > 1)[column[use]] - 1
                order = np.argsort(column, kind="stable")
                doc, column = doc[order], column[order]
                both = np.zeros((len(x), len(y)), np.float32)
                for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
                    i, j = np.searchsorted(column, [lo, lo + 4096])
                    part = np.zeros((int(doc.max()) + 1 if same else len(x) + len(y), min(4096, int(column[-1]) + 1 - lo)), np.float32)
                    part[doc[i:j], column[i:j] - lo] = 1
                    full = np.zeros((len(x) if same else len(x) + len(y), part.shape[1]), np.float32)
                    full[: len(part)] = part
                    both += full[: len(x)] @ (full if same else full[len(x) :]).T
                n1, n2 = np.array([len(s) for s in x], float), np.array([len(s) for s in y], float)
                linked = (both > 0) & (100 * both >= percent * (n1[:, None] + n2[None, :] - both))
                c1, c2 = (side.field("component").to_numpy() for side in (one, two))
                linked &= c1[:, None] != c2[None, :]
                r1, r2 = (side.field("rep").to_numpy() for side in (one, two))
                at, to = np.nonzero(linked)
                # One link for each document and component is enough to join them.
                keys = np.unique(np.stack([r1[at], c2[to], r2[to]], axis=1), axis=0) if len(at) else np.zeros((0, 3), np.int64)
                first = np.ones(len(keys), bool)
                first[1:] = (keys[1:, :2] != keys[:-1, :2]).any(axis=1)
                keys = keys[first]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(keys[:, 0], keys[:, 2])), pa.array(np.maximum(keys[:, 0], keys[:, 2]))], names=["a", "b"])

    return compare


def _remaining_links(members: DataFrame, texts: DataFrame, k: int, percent: int, block_shingles: int = 100_000, block_rows: int = 512, small: int = 64) -> DataFrame:
    """All links across components that buckets allow. Buckets of at most `small` members with the same least member are one group (of at
    most `small` members for each table), larger buckets with the same members are one group. A group that fits a block is compared whole. Others
    are cut by size, in classes so wide that links reach the next class at most, and dealt by hash over blocks; only links leave a task."""
    mixed = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("rep").alias("first"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("all")).where("lo < hi")
    group = F.when(F.col("size") <= small, F.xxhash64(F.lit(0), "first")).otherwise(F.xxhash64(F.lit(1), "size", "all"))
    left = stored(members.join(mixed.select("key", group.alias("group")), "key").groupBy("group", "rep", "n", "component").count().drop("count"))
    fit = left.groupBy("group").agg(((F.count("*") <= block_rows) & (F.sum("n") <= block_shingles)).alias("fits"))
    step = math.log(100 / percent) + 1e-6 if percent < 100 else 1e-6
    nodes = left.join(fit, "group").withColumn("band", F.when(F.col("fits"), 0).otherwise(F.floor(F.log("n") / step)).cast("long"))
    cut = nodes.groupBy("group", "band").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("n") / block_shingles)).alias("parts"))
    nodes = nodes.join(cut, ["group", "band"]).withColumn("part", F.when(F.col("fits"), 0).otherwise(F.pmod(F.xxhash64("rep"), F.col("parts"))))
    nodes = nodes.join(texts.select(F.col("doc").alias("rep"), "text"), "rep")
    rows = F.collect_list(F.struct("rep", "component", "text")).alias("rows")
    blocks = stored(nodes.groupBy("group", "band", "part", "fits").agg(rows, F.min("component").alias("lo"), F.max("component").alias("hi")))
    whole = blocks.where("fits").select(F.col("rows").alias("one"), F.lit(None).cast(blocks.schema["rows"].dataType).alias("two"), F.lit(True).alias("same"))
    one = blocks.where("not fits").select("group", F.col("band").alias("band1"), F.col("part").alias("part1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), F.explode(F.array("band", F.col("band") + 1)).alias("band2"))
    two = blocks.where("not fits").select("group", F.col("band").alias("band2"), F.col("part").alias("part2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    meet = one.join(two, ["group", "band2"]).where("(band1 < band2 or part1 <= part2) and not (lo1 = hi1 and lo2 = hi2 and lo1 = lo2)")
    meet = meet.select("group", "band1", "part1", "band2", "part2", ((F.col("band1") == F.col("band2")) & (F.col("part1") == F.col("part2"))).alias("same"))
    for side, name in ((1, "one"), (2, "two")):
        meet = meet.join(blocks.where("not fits").select("group", F.col("band").alias(f"band{side}"), F.col("part").alias(f"part{side}"), F.col("rows").alias(name)), ["group", f"band{side}", f"part{side}"])
    return whole.unionByName(meet.select("one", "two", "same")).mapInArrow(_compare_blocks(k, percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, collections: int = 12, width: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for every row of docs.

    Words are runs of bytes other than space and \\x09-\\x0D with A-Z lower-cased. Null, empty and blank texts have no
    shingles, link with nothing and are kept. A null id is never linked: its component is null and it is kept. Rows that
    repeat an id with the same text get the same answer; those that repeat it with another text are compared text by text.
    Other columns of docs are not read.
    """
    given = keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    sketch = stored(given.mapInArrow(_sketcher(shingle_words, collections, width), SKETCH))
    group = ["n", "f1", "f2"]
    reps = sketch.where("n > 0 and doc_id is not null").groupBy(*group).agg(F.min("doc").alias("rep"), F.min("doc_id").alias("least"), F.first("halves").alias("halves"))
    reps = stored(reps)
    tables = [F.xxhash64(F.lit(i * collections + j), F.col("halves")[i], F.col("halves")[j]) for i in range(collections) for j in range(i + 1, collections)]
    keys = reps.select("rep", "n", F.explode(F.array(*tables)).alias("key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key")
    buckets = stored(keys.join(shared, "key"))
    texts = stored(given.join(buckets.select(F.col("rep").alias("doc")).distinct(), "doc", "left_semi").dropDuplicates(["doc"]))
    confirm, edges = _confirm(shingle_words, percent), None
    members = buckets.withColumn("component", F.col("rep"))
    for round_no in range(2):
        pairs = _star_pairs(members, round_no).where(f"100 * least(n, n2) >= {percent} * greatest(n, n2)").select("a", "b").distinct()
        with_a = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
        with_both = with_a.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
        found = stored(with_both.mapInArrow(confirm, "a long, b long"))
        edges = found if edges is None else edges.unionByName(found)
        labels = stored(connected_components(edges))
        members = buckets.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    edges = edges.unionByName(_remaining_links(members, texts, shingle_words, percent))
    labels = stored(connected_components(edges).withColumnRenamed("id", "rep").join(reps.select("rep", "least"), "rep"))
    named = labels.groupBy("component").agg(F.min("least").alias("component_id"))
    whole = reps.select(*group, "rep", "least").join(labels.select("rep", "component").join(named, "component"), "rep", "left")
    out = sketch.select("doc_id", *group).join(whole.select(*group, F.coalesce("component_id", "least").alias("component")), group, "left")
    linked = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), linked.alias("component_id"), F.coalesce(F.col("doc_id") == linked, F.lit(True)).alias("kept"))
