"""Graphics state, rectangle joins and traversals against plain loops and hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.operators import audit, graph, graphics, spatial


def ops(*rows):
    return [{"name": r[0], "operands": r[1] if len(r) > 1 else [], "text": r[2] if len(r) > 2 else None, "image": r[0] == "Do"} for r in rows]


UNIT = [0.0, 0.0, 1.0, 1.0]


def boxes(found):
    return [(r[1], r[4:8]) for r in found]


def test_nested_matrices_apply_innermost_first():
    found = list(graphics.walk(ops(("q",), ("cm", [2.0, 0, 0, 2.0, 10.0, 0]), ("q",), ("cm", [1.0, 0, 0, 1.0, 5.0, 1.0]), ("Tj", UNIT, "a"), ("Q",), ("Tj", UNIT, "b"), ("Q",), ("Tj", UNIT, "c"))))
    assert boxes(found) == [("text", (20.0, 2.0, 22.0, 4.0)), ("text", (10.0, 0.0, 12.0, 2.0)), ("text", (0.0, 0.0, 1.0, 1.0))]
    assert [r[3] for r in found] == [2, 1, 0]


def test_turned_box():
    assert boxes(graphics.walk(ops(("cm", [0.0, 1.0, -1.0, 0, 0, 0]), ("Tj", [1.0, 2.0, 3.0, 4.0], "a")))) == [("text", (-6.0, 1.0, -2.0, 4.0))]


def test_unbalanced_stacks_and_bad_operands():
    found = list(graphics.walk(ops(("Q",), ("cm", [1.0]), ("cm", [1.0, None, 0, 1.0, 0, 0]), ("q",), ("q",), ("cm", [3.0, 0, 0, 3.0, 0, 0]), ("Tj", UNIT, "a"), ("Tj", UNIT, ""), ("Tj", [], "x"), ("Q",), ("Q",), ("Q",), ("Tj", UNIT, "b"))))
    assert boxes(found) == [("text", (0.0, 0.0, 3.0, 3.0)), ("text", (0.0, 0.0, 1.0, 1.0))]


def test_fills_by_colour_and_path():
    found = list(graphics.walk(ops(("re", UNIT), ("f",), ("rg", [1.0, 1.0, 0.9]), ("re", UNIT), ("re", [2.0, 0, 1.0, 1.0]), ("f*",), ("f",), ("g", [0.96]), ("re", UNIT), ("B",), ("k", [0.0, 0, 0, 0.5]), ("q",), ("re", UNIT), ("n",), ("re", UNIT), ("Q",), ("b",), ("BI",), ("Do",), ("Do2",))))
    assert [(r[0], r[1]) for r in found] == [(5, "fill"), (5, "fill"), (16, "fill"), (17, "image"), (18, "image")]
    assert found[2][8:] == (0.5, 0.5, 0.5)


def test_scan_from_rows_and_hidden_text(spark):
    rows = [(1, i, o["name"], [*map(float, o["operands"])], o["text"], o["image"]) for i, o in enumerate(ops(("q",), ("cm", [2.0, 0, 0, 2.0, 100.0, 100.0]), ("Tj", [0.0, 0, 10.0, 5.0], "covered"), ("Q",), ("Tj", [0.0, 0, 10.0, 5.0], "seen"), ("g", [0.0]), ("re", [100.0, 100.0, 20.0, 6.0]), ("f",), ("re", [100.0, 100.0, 50.0, 50.0]), ("f",)))]
    rows.append((2, 0, "Tj", UNIT, "alone", False))
    frame = spark.createDataFrame(rows, "page long, op_idx int, name string, operands array<double>, text string, image boolean").repartition(3)
    found = graphics.scan(graphics.page_arrays(frame, ["page"]), ["page"])
    assert [(r.page, r.op_idx, r.text, r.hidden_by, r.what) for r in graphics.hidden_texts(found, ["page"]).collect()] == [(1, 2, "covered", 7, "black filled rectangle")]
    none = spark.createDataFrame([(1, None), (2, [])], "page long, ops array<struct<name:string,operands:array<double>,text:string,image:boolean>>")
    assert graphics.scan(none, ["page"]).count() == 0


def _boxes(rng, n, size):
    out = []
    for i in range(n):
        l, b = rng.uniform(-500, 500), rng.uniform(-500, 500)
        out.append((i, (l, b, l + rng.choice(size), b + rng.choice(size))))
    return out


def _frame(spark, rows, box, idx):
    frame = spark.createDataFrame([(1, i, *map(float, x)) for i, x in rows], f"page long, {idx} long, l double, b double, r double, t double")
    return frame.select("page", idx, G.rect(*map(F.col, "lbrt")).alias(box))


@pytest.mark.parametrize("seed", [1, 2])
def test_crossing_pairs_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    a, b = _boxes(rng, 120, [0.0, 1.0, 16.0, 40.0, 900.0]), _boxes(rng, 90, [0.001, 8.0, 64.0, 300.0, 5000.0])
    found = spatial.crossing_pairs(_frame(spark, a, "x", "i"), _frame(spark, b, "y", "j"), ["page"], "x", "y").select("i", "j").collect()
    expected = {(i, j) for i, p in a for j, q in b if p[0] < q[2] and p[2] > q[0] and p[1] < q[3] and p[3] > q[1]}
    assert len(found) == len(expected) and {(r.i, r.j) for r in found} == expected


def test_a_page_of_many_boxes_is_not_quadratic(spark):
    """100,000 boxes in rows of 1,000 against as many: each crosses at most four, and few more rows than that meet in the join."""
    n = 100_000
    at = lambda shift: (F.col("id") % 1000 * 12.0 + shift, F.floor(F.col("id") / 1000) * 20.0 + shift)
    (x, y), (u, v) = at(0.0), at(3.0)
    items = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page_no"), F.col("id").alias("idx"), G.rect(x, y, x + 10, y + 10).alias("box"))
    covers = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page_no"), (F.col("id") + 1).alias("idx"), G.rect(u, v, u + 10, v + 10).alias("box"))
    found = audit.hidden_items(items, covers, least_cover=0.45)
    assert found.where("hidden_by = idx + 1").count() == n == found.count()
    left = spatial._dealt(items, ["doc_id", "page_no"], "box", F.array(F.lit(4)))
    right = spatial._dealt(covers, ["doc_id", "page_no"], "box", F.array(F.lit(4)))
    assert left.join(right, ["doc_id", "page_no", "_level", "_x", "_y"]).count() < 20 * n


def test_outside_bands(spark):
    items = _frame(spark, [(1, (0, 0, 5, 10)), (2, (900, 20, 905, 30)), (3, (0, 50, 5, 60)), (4, (0, 11, 1, 11.5))], "box", "idx")
    bands = _frame(spark, [(1, (300, 30.5, 400, 40))], "box", "idx")
    assert sorted(r.idx for r in audit.outside_bands(items, bands, ["page"]).collect()) == [1, 3, 4]
    assert audit.outside_bands(items, bands.where("false"), ["page"]).count() == 4


def test_reachable_ends_on_cycles_and_at_the_limit(spark):
    edges = [("a", i, i + 1) for i in range(9)] + [("a", 3, 1), ("a", 7, 7), ("a", 0, 2), ("b", 5, 6), ("b", 6, 5), (None, 1, 2), ("a", None, 3), ("b", 9, 10)]
    found = graph.reachable(spark.createDataFrame([("a", 0), ("a", 0), ("b", 5), (None, 1), ("b", None)], "page string, node long"), spark.createDataFrame(edges, "page string, source long, target long"), ["page"], max_depth=6)
    got = {(r.page, r.node): r.depth for r in found.collect()}
    expected = {("a", 0): 0, ("a", 1): 1, ("a", 2): 1, ("b", 5): 0, ("b", 6): 1, (None, 1): 0, (None, 2): 1} | {("a", i): i - 1 for i in range(3, 8)}
    assert got == expected and found.count() == len(expected)


def test_outline_leaves_out_cycles(spark):
    items = [("d", 1, None, 1, "x"), ("d", 2, 1, 1, "x"), ("d", 3, 1, 2, "x"), ("d", 4, 2, 1, "x"), ("d", 8, 9, 1, "x"), ("d", 9, 8, 1, "x"), ("d", 7, 77, 1, "x"), ("e", 1, None, 1, "x")]
    found = graph.outline(spark.createDataFrame(items, "doc string, node long, parent long, place int, title string"), ["doc"])
    assert {(r.doc, r.node): (r.depth, tuple(r.path)) for r in found.collect()} == {("d", 1): (0, (1,)), ("d", 2): (1, (1, 1)), ("d", 3): (1, (1, 2)), ("d", 4): (2, (1, 1, 1)), ("e", 1): (0, (1,))}


def test_an_outline_deeper_than_the_limit_is_cut(spark):
    chain = [(1, i, i - 1 if i else None, 1) for i in range(9)]
    assert graph.outline(spark.createDataFrame(chain, "doc long, node long, parent long, place int"), ["doc"], max_depth=5).agg(F.max("depth"), F.count("*")).first()[:] == (5, 6)
    assert graph.MAX_DEPTH == 32
