"""Whitening against exact fractions and a plain eigendecomposition, bit planes against products, and edge cases."""

import math

import numpy as np
import pytest

from pagemill.llm import queries, whitening

from ..conftest import SF

INF, NAN = float("inf"), float("nan")


def brute(rows, k=16):
    """By (vec_id, component) of rows (vec_id, vector): n, deviation, |whitened|, explained; all sums in Python integers."""
    x = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in rows]
    fit = sorted({v for _, v in x})
    n, d = len(fit), len(fit[0])
    s = [sum(v[j] for v in fit) for j in range(d)]
    cov = np.array([[(n * sum(v[a] * v[b] for v in fit) - s[a] * s[b]) / (n * n) for b in range(d)] for a in range(d)])
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1], w[:, ::-1]
    out = []
    for i, v in x:
        centred = [n * c - t for c, t in zip(v, s, strict=True)]
        for c in range(min(k, d)):
            out.append((i, c + 1, n, sum(u * u for u in centred), abs(float(np.dot(np.array(centred, float) / n, w[:, c]) / math.sqrt(e[c]))), e[c] / e.sum()))
    return out


def same(found, expected):
    found = sorted(found, key=lambda r: (r.vec_id, r.component, abs(r.whitened)))
    expected = sorted(expected, key=lambda r: (r[0], r[1], r[4]))
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in found] == [r[:4] for r in expected]
    assert [int(r.deviation_wide) for r in found] == [r[3] for r in expected]
    assert np.allclose([abs(r.whitened) for r in found], [r[4] for r in expected], atol=1e-8)
    assert np.allclose([r.explained for r in found], [r[5] for r in expected], rtol=1e-9)
    assert all(r.identity_error < 1e-8 for r in found)


def test_op12_on_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    same(queries.op12_whitening(spark, SF).collect(), brute(rows))


@pytest.mark.parametrize("bits", [3, 40])
def test_planes_hold_all_products(bits):
    u = np.random.default_rng(bits).integers(0, 1 << bits, (133, 4))
    u[:, 2] = 5
    widths = [int(c.max()).bit_length() for c in u.T]
    found = whitening.plane_products(whitening.bit_planes(u, widths), widths)
    expected = u.astype(object).T @ u.astype(object)
    assert [[found[i][j] for j in range(i, 4)] for i in range(4)] == [[expected[i][j] for j in range(i, 4)] for i in range(4)]


def test_edges(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(c) for c in rng.normal(size=5)]) for i in range(40)]
    good += [(3, good[3][1]), (50, good[7][1]), (51, [c + 1e-9 for c in good[8][1]])]
    bad = [(60, None), (61, [1.0, None, 0.0, 0.0, 0.0]), (62, [NAN] * 5), (63, [INF, 0.0, 0.0, 0.0, 0.0]), (64, []), (65, [1.0, 2.0])]
    given = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in good + bad], "vec_id long, embedding array<double>, component int, n long, x string").repartition(3)
    same(whitening.whiten(given).collect(), brute(good))


def test_huge_entries_and_constant_dimensions(spark):
    rows = [(i, [1e30 if i % 2 else -1e30, 0.5, i / 3]) for i in range(9)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 27 and all(r.deviation is None and r.deviation_wide > 1 << 63 for r in found)
    assert all((r.whitened is None) == (r.component > 1) for r in found) and all(r.identity_error < 1e-6 for r in found)


def test_without_variance_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    found = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5]), (None, [0.5, 0.5])], schema)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in found] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)] * 2
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
