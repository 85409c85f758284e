"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its triangular factor.

A vector c becomes the integers x = floor(64 c) + 1,000,000. Different x vectors are the fit list, each once. Its sums are
exact; its covariance comes from vectors that are centred before they are multiplied, summed within partitions first.
Only dimensions squared numbers go to the driver, whatever the number of vectors.

There V = P L L' P' by Cholesky with diagonal pivoting, which stops at the rank; rotating the columns of L until they are
orthogonal (L J = U D) gives V = P U D^2 U' P' at once: norms of the rotated columns are roots of eigenvalues, normalised
columns are components. V is not decomposed itself, and small eigenvalues keep their relative precision.

Rows whose vector is null, empty, or holds null, non-finite or huge entries (2^54 and more, too large for
sums and differences of longs 64-fold) are left out, and so are vectors of another length than the commonest one (the longest of those that are equally
common), as they have no place in its space. Repeated vectors count once in the fit and get a row each. Components of no
variance (constant columns, fewer vectors than dimensions) can't be scaled to 1 and are none; equal eigenvalues have
their components in any order. An empty table gives an empty one; other columns are ignored. A row has no text; its vector's
length is bounded by DIMENSIONS, as the driver decomposes dimensions squared numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SCALE, SHIFT = 64, 1_000_000
#: Components that are returned at most, and dimensions a vector may have.
COMPONENTS, DIMENSIONS = 16, 2048
#: Diagonal entries under so much of the largest are no variance but rounding.
RANK = 1e-13


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id and x, an array of longs, for each row that has a whole vector."""
    c = F.transform("embedding", lambda e: e.cast("double"))
    bad = F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) >= 2.0**54))
    x = F.transform(c, lambda e: F.floor(e * SCALE).cast("long") + SHIFT)
    rows = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(~bad).select("vec_id", x.alias("x"))
    commonest = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d"))).first()[0]
    if commonest and commonest["d"] > DIMENSIONS:
        raise ValueError(f"vectors have {commonest['d']} dimensions, more than {DIMENSIONS}")
    return rows.filter(F.size("x") == (commonest["d"] if commonest else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def sums(vectors: DataFrame, column: str, kind: str) -> list:
    """The sum of each dimension; kind is the type of what is added up."""
    added = vectors.select(F.posexplode(column).alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast(kind)).alias("s"))
    return [r["s"] for r in added.orderBy("i").collect()]


def scatter(vectors: DataFrame, column: str, origin: list, rest: np.ndarray) -> np.ndarray:
    """Sum of (v - origin - rest)(v - origin - rest)' over the rows; of integers, origin is subtracted exactly."""
    d = len(rest)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            if b.num_rows:
                z = (_matrix(b.column(0)) - np.array(origin)) - rest
                total += z.T @ z
        yield pa.record_batch([pa.array(upper[0]), pa.array(upper[1]), pa.array(total[upper])], ["i", "j", "s"])

    out = np.zeros((d, d))
    for r in vectors.select(column).mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"]
    return out


def cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, L): v[order][:, order] = L L', L lower trapezoidal with as many columns as v has rank."""
    v, d = v.copy(), len(v)
    order, low, rank = np.arange(d), np.zeros((d, d)), 0
    top = max(v.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        p = k + int(np.argmax(v.diagonal()[k:]))
        if v[p, p] <= RANK * top:
            break
        if p != k:
            v[[k, p]], order[[k, p]], low[[k, p], :k] = v[[p, k]], order[[p, k]], low[[p, k], :k]
            v[:, [k, p]] = v[:, [p, k]]
        low[k, k] = np.sqrt(v[k, k])
        low[k + 1 :, k] = v[k + 1 :, k] / low[k, k]
        v[k + 1 :, k + 1 :] -= np.outer(low[k + 1 :, k], low[k + 1 :, k])
        rank = k + 1
    return order, low[:, :rank]


def _meetings(r: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rounds in which r columns meet in disjoint pairs, until every two have met."""
    ring = list(range(r)) + [-1] * (r % 2)
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[: len(ring) // 2], ring[::-1]) if min(a, b) >= 0]
        yield np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def jacobi(low: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """low with its columns rotated in pairs until all are orthogonal to double precision."""
    g = low.copy()
    for _ in range(sweeps):
        turned = False
        for p, q in _meetings(g.shape[1]):
            x, y = g[:, p], g[:, q]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            off = np.abs(c) > len(g) * np.finfo(float).eps * np.sqrt(a * b)
            turned |= bool(off.any())
            zeta = (b - a) / np.where(off, 2 * c, 1.0)
            t = np.where(off, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            cos = 1 / np.hypot(1.0, t)
            g[:, p], g[:, q] = cos * x - cos * t * y, cos * t * x + cos * y
        if not turned:
            break
    return g


def decomposed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of v, falling, and components as columns."""
    order, low = cholesky(v)
    turned = jacobi(low)
    norms = np.sqrt((turned * turned).sum(0))
    by = np.argsort(-norms, kind="stable")
    components = np.zeros_like(turned)
    components[order] = turned[:, by] / norms[by]
    return norms[by] ** 2, components


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation (decimal, exact), whitened, explained and identity_error for each row and component."""
    rows = cut(integers(vectors))
    fit = cut(rows.select("x").distinct())
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    first = fit.first()
    if not first:
        return rows.sparkSession.createDataFrame([], schema)
    n, total = fit.count(), [int(t) for t in sums(fit, "x", "decimal(20,0)")]
    # Whole parts of the means are subtracted as integers, so that nothing is lost before the products are taken.
    origin = [t // n for t in total]
    rest = np.array([(t - o * n) / n for t, o in zip(total, origin)])
    v = scatter(fit, "x", origin, rest) / n
    values, vectors_ = decomposed(v)
    k = min(components, len(values))
    turn = vectors_[:, :k] / np.sqrt(values[:k])

    def projected(x: pa.Array) -> np.ndarray:
        return ((_matrix(x) - np.array(origin)) - rest) @ turn

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([_lists(projected(b.column(0)))], ["w"])

    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    w = cut(fit.mapInArrow(project, "w array<double>"))
    mean = np.array(sums(w, "w", "double")) / n
    error = float(np.abs(scatter(w, "w", [0.0] * k, mean) / n - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("x"))
                # n (x - origin) - (S - n origin), in 64 bits where all fits and else in numbers of any length.
                far = max(abs(int(x.max()) - min(origin)), abs(int(x.min()) - max(origin))) + 1
                wide = np.int64 if len(origin) * (n * far) ** 2 < 1 << 62 else object
                y = (x - np.array(origin)).astype(wide) * n - np.array([t - o * n for t, o in zip(total, origin)], wide)
                deviation = pa.array([int(s) for s in (y * y).sum(1)], pa.decimal128(38, 0))
                yield pa.record_batch([b.column("vec_id"), deviation, _lists(projected(b.column("x")))], ["vec_id", "deviation", "w"])

    out = rows.mapInArrow(run, "vec_id long, deviation decimal(38,0), w array<double>").select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    explained = F.get(F.array(*(F.lit(float(e)) for e in values[:k] / np.trace(v))), F.col("at"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
