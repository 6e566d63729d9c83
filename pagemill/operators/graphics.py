"""Graphics state over a page's drawing operators: boxes of texts and of what is painted over them, hidden texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.operators.audit import first_cover
from pagemill.operators.spatial import crossing_pairs

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: Operators by what they do to the path; and the part of a colour from which it counts as white.
SHOWS, FILLS, ENDS = frozenset(("Tj", "TJ", "'", '"')), frozenset(("f", "F", "f*", "B", "B*", "b", "b*")), frozenset("Ssn")
PATH = frozenset(("m", "l", "c", "v", "y", "h", "re"))
WHITE = 0.95
_FOUND = "op_idx int, kind string, text string, depth int, l double, b double, r double, t double, red double, green double, blue double"


def joined(local: Matrix, m: Matrix) -> Matrix:
    """The map that applies `local` first and then m."""
    a, b, c, d, e, f = local
    return (a * m[0] + b * m[2], a * m[1] + b * m[3], c * m[0] + d * m[2], c * m[1] + d * m[3], e * m[0] + f * m[2] + m[4], e * m[1] + f * m[3] + m[5])


def mapped_box(m: Matrix, x: float, y: float, w: float, h: float) -> tuple[float, float, float, float]:
    """The upright box around a rectangle under m."""
    corners = [(m[0] * p + m[2] * q + m[4], m[1] * p + m[3] * q + m[5]) for p, q in ((x, y), (x + w, y), (x, y + h), (x + w, y + h))]
    xs, ys = [p for p, _ in corners], [q for _, q in corners]
    return min(xs), min(ys), max(xs), max(ys)


def walk(ops: list[dict]) -> Iterator[tuple]:
    """Rows of _FOUND for one page: a stack machine over its operators in order.

    q saves the matrix and Q takes it back (without effect on an empty stack; what is saved at the page's end is forgotten); cm puts a map before it. The fill
    colour is not saved, as white at the start. re adds a box to the path, a fill paints the path unless the colour is all but white, any end of the path
    empties it. Operators with too few or null operands do nothing. depth is the number of saved matrices.
    """
    m, saved, colour, path = IDENTITY, [], (1.0, 1.0, 1.0), []
    for i, op in enumerate(ops):
        name, v = op["name"], op["operands"] or []
        if None in v:
            v = []
        if name == "q":
            saved.append(m)
        elif name == "Q":
            m = saved.pop() if saved else m
        elif name == "cm" and len(v) >= 6:
            m = joined(tuple(v[:6]), m)
        elif name == "rg" and len(v) >= 3:
            colour = tuple(v[:3])
        elif name == "g" and v:
            colour = (v[0],) * 3
        elif name == "k" and len(v) >= 4:
            colour = tuple((1 - c) * (1 - v[3]) for c in v[:3])
        elif name == "re" and len(v) >= 4:
            path.append(mapped_box(m, *v[:4]))
        elif name in FILLS:
            if min(colour) < WHITE:
                for box in path:
                    yield (i, "fill", None, len(saved), *box, *colour)
            path = []
        elif name in ENDS:
            path = []
        elif name in SHOWS and op["text"] and len(v) >= 4:
            yield (i, "text", op["text"], len(saved), *mapped_box(m, *v[:4]), *colour)
        elif name == "BI" or name == "Do" and op["image"]:
            yield (i, "image", None, len(saved), *mapped_box(m, 0.0, 0.0, 1.0, 1.0), *colour)


def page_arrays(ops: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ops) from operators as rows (keys, op_idx, name, operands, text, image): those of a page in order, for scan. One page is one group."""
    return ops.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("op_idx", "name", "operands", "text", "image"))), lambda x: F.struct(x["name"], x["operands"], x["text"], x["image"])).alias("ops"))


def scan(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, op_idx, kind, text, depth, box, red, green, blue): texts, fills and images with their boxes on the page, from pages
    (keys, ops array<struct<name, operands, text, image>>). op_idx is the place in ops; null ops have no rows."""
    key_types = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, ops in enumerate(batch.column("ops")):
                found = list(walk(ops.as_py() or []))
                at.extend([i] * len(found))
                rows.extend(found)
            own = [batch.column(k).take(pa.array(at, pa.int64())) for k in keys]
            types = [pa.int32(), pa.string(), pa.string(), pa.int32(), *[pa.float64()] * 7]
            columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*own, *columns], names=[*keys, *(x.split()[0] for x in _FOUND.split(", "))])

    found = pages.select(*keys, "ops").mapInArrow(run, f"{key_types}, {_FOUND}")
    return found.select(*keys, "op_idx", "kind", "text", "depth", G.rect(*map(F.col, "lbrt")).alias("box"), "red", "green", "blue")


def covering_operators(ops: list[dict]) -> list[int]:
    """Places of the fills that could hide text, with the parts of the path that they paint: those in a colour that is not all but white. A fill without a path
    has no effect and stays, as strokes and images do. No colour set yet counts as white."""
    dark, path, out = False, [], []
    for i, op in enumerate(ops):
        name, v = op["name"], op["operands"] or []
        if None in v:
            v = []
        if name == "rg" and len(v) >= 3:
            dark = min(v[:3]) < WHITE
        elif name == "g" and v:
            dark = v[0] < WHITE
        elif name == "k" and len(v) >= 4:
            dark = min((1 - c) * (1 - v[3]) for c in v[:3]) < WHITE
        elif name in PATH:
            path.append(i)
        elif name in FILLS:
            out += [*path, i] if dark and path else []
            path = []
        elif name in ENDS:
            path = []
    return out


def without_covers(pages: DataFrame, keys: list[str]) -> DataFrame:
    """pages (keys, ops) with the operators left when all fills that could hide text are stripped, for reading what lies below; null ops stay null."""
    key_types = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for ops in batch.column("ops").to_pylist():
                gone = set(covering_operators(ops or []))
                kept.append(None if ops is None else [op for i, op in enumerate(ops) if i not in gone])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(kept, batch.schema.field("ops").type)], names=[*keys, "ops"])

    return pages.select(*keys, "ops").mapInArrow(run, f"{key_types}, ops {pages.schema['ops'].dataType.simpleString()}")


def described() -> F.Column:
    """What a fill or an image is called in a report."""
    two = lambda c: F.format_string("%.2f", F.col(c))
    even = (F.abs(F.col("red") - F.col("green")) < 1e-6) & (F.abs(F.col("green") - F.col("blue")) < 1e-6)
    colour = F.when((F.col("red") == 0) & even, "black").when(even, F.concat(F.lit("gray("), two("red"), F.lit(")"))).otherwise(F.concat(F.lit("rgb("), two("red"), F.lit(","), two("green"), F.lit(","), two("blue"), F.lit(")")))
    return F.when(F.col("kind") == "image", "image").otherwise(F.concat(colour, F.lit(" filled rectangle")))


def hidden_texts(found: DataFrame, keys: list[str], least_cover: float = 0.5) -> DataFrame:
    """(keys, op_idx, text, box, hidden_by, what): texts of a scan that one later fill or image covers by at least half, with the first such one."""
    texts = found.where("kind = 'text'").select(*keys, F.col("op_idx").alias("idx"), "text", "box")
    covers = found.where("kind <> 'text'").select(*keys, F.col("op_idx").alias("cover_idx"), described().alias("what"), F.col("box").alias("cover"))
    pairs = crossing_pairs(texts, covers, keys, "box", "cover").where((F.col("cover_idx") > F.col("idx")) & (G.cover_share(F.col("box"), F.col("cover")) >= least_cover))
    first = first_cover(pairs, [*keys, "idx"], ["text", "box"], ["what"])
    return first.select(*keys, F.col("idx").alias("op_idx"), "text", "box", "hidden_by", "what")
