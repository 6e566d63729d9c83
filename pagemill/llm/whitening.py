"""PCA whitening of embeddings on exact integer cross-products.

Entries become integers, floor(64 c) + 1000000. Less its dimension's least value each is a small non-negative number, whose bits
are dealt out over bit planes: one plane for each dimension and bit, with one bit for each row, packed into 64-bit words. The sum of products of
two dimensions is then the sum over their planes a, b of 2^(a+b) times the number of rows with both bits, an AND and a popcount on
words. Tasks send one number for each pair of dimensions; the driver centres them as integers (n sum(uv) - sum(u) sum(v)) and only
then divides and takes eigenvectors, so nothing is lost to cancellation and the result does not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import stored

SCALE, SHIFT = 64, 1_000_000
#: Scaled entries beyond this magnitude count as it, so that sums of products fit in 38 digits for 2^34 rows.
LARGEST = 1 << 45
_WIDE = pa.decimal128(38, 0)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vector is neither null nor holds a null, NaN or infinite entry, stored. Vectors without entries
    and those of another length than most rows have (of two as frequent, the longer) are dropped likewise."""
    entry = F.col("v")
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(entry.isNotNull() & (F.size(entry) > 0) & F.forall(entry, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf")))))
    limit = F.lit(float(LARGEST))
    found = good.select("vec_id", F.transform(entry, lambda c: F.floor(F.greatest(F.least(c * F.lit(float(SCALE)), limit), -limit)).cast("long") + F.lit(SHIFT)).alias("x"))
    rows = stored(found)
    usual = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("x") == (usual.d if usual else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


@dataclass
class Sums:
    """Of the fit list: how many vectors, and by dimension the least value, the range and the sum of x."""

    n: int
    least: list[int]
    span: list[int]
    total: list[int]


def dimension_sums(fit: DataFrame) -> Sums:
    """One row for each task and dimension is sent; the driver gets one for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, total = 0, None, None, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                own = [x.min(axis=0), x.max(axis=0), x.astype(object).sum(axis=0) if np.abs(x).max() > 1 << 40 else x.sum(axis=0).astype(object)]
                low, high, total = own if n == 0 else [np.minimum(low, own[0]), np.maximum(high, own[1]), total + own[2]]
                n += batch.num_rows
        if n:
            d = len(low)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(low), pa.array(high), pa.array([Decimal(v) for v in total.tolist()], _WIDE)], names=["i", "n", "low", "high", "total"])

    sent = fit.mapInArrow(run, "i int, n long, low long, high long, total decimal(38,0)")
    rows = sent.groupBy("i").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total")).orderBy("i").collect()
    return Sums(rows[0].n if rows else 0, [r.low for r in rows], [r.high - r.low for r in rows], [int(r.total) for r in rows])


def bit_planes(u: np.ndarray, widths: list[int]) -> np.ndarray:
    """Planes by dimension and bit, lowest first: for each the rows' bits in 64-bit words, zeros after the last row."""
    words = -(-len(u) // 64)
    out = np.zeros((sum(widths), words * 8), np.uint8)
    k = 0
    for i, width in enumerate(widths):
        column = u[:, i]
        for a in range(width):
            packed = np.packbits(((column >> a) & 1).astype(np.uint8))
            out[k, : len(packed)] = packed
            k += 1
    return out.view(np.uint64)


def plane_products(planes: np.ndarray, widths: list[int]) -> np.ndarray:
    """Upper triangle of the sums of products of all pairs of dimensions, as Python integers."""
    d = len(widths)
    out = np.zeros((d, d), object)
    starts = np.cumsum([0, *widths])
    weights = np.concatenate([np.array([1 << b for b in range(w)], object) for w in widths]) if d else np.zeros(0, object)
    small = 2 * max(widths, default=0) + int(planes.shape[1] * 64).bit_length() < 62
    weights = weights.astype(np.int64) if small else weights
    for i in range(d):
        row = 0
        for a in range(widths[i]):
            both = np.bitwise_count(planes[starts[i] :] & planes[starts[i] + a]).sum(axis=1, dtype=np.int64)
            by_bit = (both if small else both.astype(object)) * weights[starts[i] :]
            row = row + np.add.reduceat(by_bit, starts[i:-1] - starts[i]).astype(object) * (1 << a)
        out[i, i:] += row
    return out


def cross_products(fit: DataFrame, sums: Sums) -> list[list[int]]:
    """Exact sums of u_i u_j over the fit list, u = x - least; constant dimensions have no planes and products of 0."""
    d, least = len(sums.least), np.array(sums.least, np.int64)
    active = [i for i in range(d) if sums.span[i]]
    widths = [sums.span[i].bit_length() for i in active]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(active), len(active)), object)
        for batch in batches:
            if batch.num_rows:
                total += plane_products(bit_planes((_matrix(batch) - least)[:, active], widths), widths)
        a, b = np.triu_indices(len(active))
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array([Decimal(int(v)) for v in total[a, b]], _WIDE)], names=["a", "b", "v"])

    out = [[0] * d for _ in range(d)]
    if active:
        for r in fit.mapInArrow(run, "a int, b int, v decimal(38,0)").groupBy("a", "b").agg(F.sum("v").alias("v")).collect():
            i, j = active[r.a], active[r.b]
            out[i][j] = out[j][i] = int(r.v)
    return out


def covariance(sums: Sums, products: list[list[int]]) -> np.ndarray:
    """(n P - u u') / n^2 with the difference in integers; each entry is rounded once."""
    n, d = sums.n, len(sums.least)
    u = [t - n * low for t, low in zip(sums.total, sums.least, strict=True)]
    return np.array([[(n * products[i][j] - u[i] * u[j]) / (n * n) for j in range(d)] for i in range(d)], float).reshape(d, d)


def _centred(x: np.ndarray, sums: Sums) -> np.ndarray:
    """n x - S exactly, in 64-bit integers where they hold it."""
    u = [t - sums.n * low for t, low in zip(sums.total, sums.least, strict=True)]
    kind = np.int64 if sums.n * (max(sums.span) + 1) < 1 << 62 else object
    return (x - np.array(sums.least, np.int64)).astype(kind) * sums.n - np.array(u, object).astype(kind)


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_wide), one row for each remaining vector and
    component up to `components` or the dimension.

    Rows that quantised() drops have no rows here; of repeated ids each row is transformed, and null ids stay null. The fit list holds each distinct
    x once. A component without variance (constant vectors, fewer vectors than dimensions) has whitened null and explained 0, or
    null when no component has any. deviation is null where it does not fit in a long; deviation_wide always holds it. identity_error is
    measured on the whitened fit list, over the components with variance; null when there are none. Other columns are not read. An
    empty table gives an empty result.
    """
    rows = quantised(vectors, id_col, vector_col)
    fit = stored(rows.select("x").distinct())
    sums = dimension_sums(fit)
    d, k = len(sums.least), min(components, len(sums.least))
    v = covariance(sums, cross_products(fit, sums))
    values, basis = np.linalg.eigh(v) if d else (np.zeros(0), np.zeros((0, 0)))
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    trace = float(np.trace(v))
    real = int((values > d * np.finfo(float).eps * max(float(values.max(initial=0.0)), 0.0)).sum())
    project = basis[:, :real] / np.sqrt(values[:real])
    explained = [float(e) / trace if c < real else 0.0 for c, e in enumerate(values)] if trace > 0 else [None] * k
    n = sums.n

    def whitened(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centred = _centred(x, sums)
        return centred, (centred.astype(float) / n) @ project

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((real + 1, real))
        for batch in batches:
            if batch.num_rows:
                _, w = whitened(_matrix(batch))
                total += np.vstack([w.sum(axis=0), w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["at", "v"])

    error = None
    if real:
        found = {r["at"]: r["v"] for r in fit.mapInArrow(moments, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}
        total = np.array([found[i] for i in range((real + 1) * real)]).reshape(real + 1, real) / n
        error = float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(real)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            centred, w = whitened(_matrix(batch))
            fits = d * (n * (max(sums.span) + 1)) ** 2 < 1 << 63
            deviation = (centred * centred if fits else centred.astype(object) ** 2).sum(axis=1)
            each = np.repeat(np.arange(m), k)
            padded = np.zeros((m, k))
            padded[:, :real] = w
            lacks = np.tile(np.arange(k) >= real, m)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    pa.array([int(v) if v < 1 << 63 else None for v in deviation], pa.int64()).take(pa.array(each)),
                    pa.array(padded.ravel(), mask=lacks),
                    pa.array(explained * m, pa.float64()),
                    pa.array([error] * (m * k), pa.float64()),
                    pa.array([Decimal(int(v)) for v in deviation], _WIDE).take(pa.array(each)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_wide"],
            )

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_wide decimal(38,0)"
    return rows.mapInArrow(run, schema)
