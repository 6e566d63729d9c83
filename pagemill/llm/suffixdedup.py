"""Removal of repeated byte strings by distributed prefix doubling on sampled suffixes.

A byte goes when it lies in a string of `length` bytes that also starts anywhere else. Ranks of prefixes (fingerprints that are
equal exactly for equal prefixes) are sorted by Spark at growing lengths, and positions whose rank is unique drop out:

* `length`/4 bytes: within every window of `length` bytes the leftmost smallest prefix hash marks an anchor. Equal windows have
  equal anchors at equal places, so only anchors (about one in 75 bytes at 200) are ranked; the ranks of a window's other
  positions follow from its anchor's.
* beyond `length`: the stretch of all windows that share an anchor is ranked whole. Stretches with an equal elsewhere are settled:
  all their windows repeat.
* `length` bytes: where an anchor's stretches differ (near the ends of copies and around edits), its windows are ranked in groups of
  eight neighbours: by the rank of the bytes that all eight share, then with the bytes around them, group by group where those are
  equal too and window by window where they are not. One stretch stands for all its equals.

Prefix ranks inside a text come from prefix sums over its bytes, in the task that holds the text, so no round has to fetch the
rank at an offset through a shuffle. Nothing is capped: every position is an anchor's, and every anchor is ranked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import keyed, mix, prefix_hash, short_span_hash, span_hash, stored, text_chunks

_POSITION = np.uint64(0xFFFFFF)


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, anchor rank, stretch rank) of every anchor; windows as positions in the document."""
    k = length // 4
    span = length - k + 1
    n = len(data) - k + 1
    empty = tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    if n < span:
        return empty
    prefix = prefix_hash(data)
    at = np.arange(n)
    grams = (short_span_hash if k < 512 else span_hash)(prefix, at, at + k)
    keys = np.full(-(-n // span) * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    keys[:n] = (grams & ~_POSITION) | at.astype(np.uint64)
    blocks = keys.reshape(-1, span)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(data) - length + 1
    least = (np.minimum(right[:windows], left[span - 1 : span - 1 + windows]) & _POSITION).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:windows]
    inside = np.arange(windows) + length <= offsets[doc + 1]
    start = inside.copy()
    start[1:] &= (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(start)
    if not len(first):
        return empty
    stops = inside.copy()
    stops[:-1] &= start[1:] | ~inside[1:]
    last = np.flatnonzero(stops)
    anchor, of = least[first], doc[first]
    shape = ((anchor - first) << 20 | (last - first)).astype(np.uint64)
    stretch = mix(span_hash(prefix, first, last + length) ^ mix(shape + np.uint64(1)))
    return of, first - offsets[of], last - offsets[of], grams[anchor], stretch


def _pieces(column: pa.Array, length: int, most: int = 1 << 22) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, position of the first byte in its document): chunks, with very long texts in overlapping parts."""
    for lo, hi, data, offsets in text_chunks(column, 1 << 17):
        if len(data) <= most:
            yield lo, data, offsets, 0
        else:  # a single text
            for at in range(0, max(len(data) - length + 1, 1), most):
                part = data[at : at + most + length - 1]
                yield lo, part, np.array([0, len(part)]), at


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for row, data, offsets, shift in _pieces(batch.column("text"), length):
                of, first, last, rank, stretch = anchor_runs(data, offsets, length)
                yield pa.RecordBatch.from_arrays([pa.array(rank.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(ids[row + of]), pa.array(first + shift), pa.array((last - first).astype(np.int32))], names=["h", "sw", "doc", "at", "more"])

    return run


def _packed(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The seven bytes from each position as one number, the first byte highest; bytes outside the text are 0."""
    padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)]).astype(np.int64)
    out = np.zeros(len(at), np.int64)
    for t in range(7):
        out = out << 8 | padded[at + 8 + t]
    return out


def _groups(length: int):
    """Eight neighbouring windows at a time: the rank of what all of them share, and the seven bytes before and after that."""
    k = length // 4
    span = length - k + 1
    kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 2 + [pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = np.frombuffer((batch.column("text")[row].as_py() or "").encode(), np.uint8)
                runs = batch.column("runs")[row].values
                first, more, single = (runs.field(f).to_numpy(zero_copy_only=False) for f in ("at", "more", "single"))
                prefix = prefix_hash(data)
                at = np.arange(len(data) - k + 1)
                grams = (short_span_hash if k < 512 else span_hash)(prefix, at, at + k) & ~_POSITION
                anchor = np.array([p + grams[p : p + span].argmin() for p in first])
                base = anchor - 8 * (span // 8 + 1)
                j0, j1 = (first - base) // 8, (first + more - base) // 8
                n = j1 - j0 + 1
                of = np.repeat(np.arange(len(first)), n)
                p0 = base[of] + 8 * (j0[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
                lo, hi = np.maximum(first[of] - p0, 0), np.minimum(first[of] + more[of] - p0, 7)
                core = span_hash(prefix, p0 + 7, p0 + length)
                columns = [core.view(np.int64), _packed(data, p0), _packed(data, p0 + length), lo, hi, np.full(len(of), batch.column("doc")[row].as_py()), p0, single[of]]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(kind) for c, kind in zip(columns, kinds, strict=True)], names=["core", "before", "after", "lo", "hi", "doc", "at", "single"])

    return run


class Members:
    """A bitmap over ids modulo a prime: ids that are not in it are not among those it was made from. At most 8 MB."""

    def __init__(self, ids: DataFrame, most_bits: int = 1 << 26):
        n = ids.count()
        bits = min(max(16 * n, 1 << 12), most_bits)
        self.mod = next(p for p in range(bits | 1, 2 * bits, 2) if all(p % d for d in range(3, int(p**0.5) + 1, 2)))
        slots = ids.select(F.pmod("doc", F.lit(self.mod)).alias("slot"))
        words = slots.groupBy(F.expr("CAST(slot DIV 32 AS INT)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot % 32 AS INT)))").alias("b")).toArrow()
        held = np.zeros(self.mod // 32 + 1, np.int64)
        held[words.column("w").to_numpy()] = words.column("b").to_numpy()
        self.held = held.astype(np.uint32)

    def may_have(self, ids: np.ndarray) -> np.ndarray:
        slot = ids % self.mod
        return (self.held[slot // 32] >> (slot % 32).astype(np.uint32)) & 1 == 1


def _kept_by(docs: DataFrame, members: Members) -> DataFrame:
    """docs whose id the bitmap may have; filtered before any text is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                yield part.filter(pa.array(sent.value.may_have(part.column("doc").to_numpy())))

    return docs.mapInArrow(run, docs.schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with overlapping and touching ones joined."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _cut(members: Members | None = None):
    """Cuts each text's spans out; with a bitmap, only of documents that are not in it, which have none."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part, rows = batch.slice(lo, 1000), []
                skip = members.value.may_have(part.column("doc").to_numpy()) if members else np.zeros(part.num_rows, bool)
                for i in np.flatnonzero(~skip):
                    raw = (part.column("text")[i].as_py() or "").encode()
                    found = [] if members else part.column("spans")[i].as_py() or []
                    spans = merged([(x["start"], x["end"]) for x in found])
                    digest, at = hashlib.sha256(), 0
                    for s, e in [*spans, (len(raw), len(raw))]:
                        digest.update(raw[at:s])
                        at = e
                    rows.append((part.column("doc_id")[i].as_py(), len(raw), sum(e - s for s, e in spans), len(spans), digest.hexdigest(), [{"start": s, "end": e} for s, e in spans]))
                columns = zip(*rows, strict=True) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)

    return run


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc, start, end) of byte stretches of docs (doc, text) that are covered by repeated strings; they may overlap."""
    occurrences = stored(docs.mapInArrow(_anchors(length), "h long, sw long, doc long, at long, more int"))
    # Stored, so that both sides of the join are plain exchanges and the adaptive skew join can split a hot rank.
    again = stored(occurrences.groupBy("h").count().where("count > 1").select("h"))
    shared = stored(occurrences.join(again, "h"))
    classes = shared.groupBy("h", "sw").agg(F.count("*").alias("n"), F.min(F.struct("doc", "at", "more")).alias("one"))
    classes = stored(classes)
    settled = shared.join(classes.where("n > 1").select("h", "sw"), ["h", "sw"], "left_semi").select("doc", F.col("at").alias("start"), (F.col("at") + F.col("more") + length).alias("end"))
    open_anchors = classes.groupBy("h").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").select("h")
    todo = classes.join(open_anchors, "h", "left_semi").select("one.doc", "one.at", "one.more", (F.col("n") == 1).alias("single"))
    todo = todo.groupBy("doc").agg(F.collect_list(F.struct("at", "more", "single")).alias("runs"))
    todo = stored(todo)
    near = _kept_by(docs, Members(todo.select("doc"))).join(todo, "doc").dropDuplicates(["doc"]).select("doc", "text", "runs")
    groups = near.mapInArrow(_groups(length), "core long, before long, after long, lo int, hi int, doc long, at long, single boolean")
    core, hull = Window.partitionBy("core"), Window.partitionBy("core", "before", "after", "lo", "hi")
    counted = groups.withColumn("n_core", F.count("*").over(core)).where("n_core > 1")
    counted = counted.withColumn("n_same", F.count("*").over(hull)).withColumn("nth", F.row_number().over(hull.orderBy("doc", "at")))
    counted = stored(counted.withColumn("open", F.max(F.col("single") & (F.col("n_same") == 1)).over(core)).where("open or (single and n_same > 1)"))
    whole = counted.where("single and n_same > 1").select("doc", (F.col("at") + F.col("lo")).alias("start"), (F.col("at") + F.col("hi") + length).alias("end"))
    windows = counted.where("open and nth = 1").select("core", "before", "after", "doc", "at", (F.col("single") & (F.col("n_same") == 1)).alias("single"), F.explode(F.sequence("lo", "hi")).alias("i"))
    # Of window i all bytes are the shared ones, the nearest 7 - i before them and the first i after them.
    left = F.expr("before & (shiftleft(1L, 8 * (7 - i)) - 1L)")
    same = Window.partitionBy("core", "i", left, F.expr("shiftright(after, 8 * (7 - i))"))
    lone = windows.withColumn("n", F.count("*").over(same)).where("single and n > 1").select("doc", (F.col("at") + F.col("i")).alias("start"), (F.col("at") + F.col("i") + length).alias("end"))
    return settled.unionByName(whole).unionByName(lone)


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans), one row for every row of docs; spans in bytes, disjoint.

    Texts are UTF-8 bytes; null and empty texts have none and lose none, nor do texts of under `length` bytes. Matches never cross
    documents; overlapping ones count, and all are judged on the input. A document is known by its id: rows that repeat an id
    repeat its text, and count as copies. A null id is known by its text. An empty table gives no rows.
    """
    if length < 8 or length % 4:
        raise ValueError("length is a multiple of 4, at least 8")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    given = keyed(given)
    found = repeated_spans(given.select("doc", "text"), length)
    spans = stored(found.distinct().groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    members = Members(spans.select("doc"))
    none = given.mapInArrow(_cut(docs.sparkSession.sparkContext.broadcast(members)), kinds)
    some = _kept_by(given, members).join(spans, "doc", "left").select("doc_id", "text", "spans")
    return none.unionByName(some.mapInArrow(_cut(), kinds))
