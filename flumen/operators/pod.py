"""Proper orthogonal decomposition of snapshots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .phase import fit_harmonic

#: Snapshots up to which the covariance of snapshots goes to the driver (its square of numbers).
MOST = 2_000


def fluctuations(snapshots: DataFrame, min_fraction: float = 0.0, weight: float | None = None) -> DataFrame:
    """snapshot, dof, x: weighed value less the dof's mean, over dofs that enough snapshots have; their gaps are 0 and
    have no row."""
    n = snapshots.select("snapshot").distinct().agg(F.count("*").alias("n_snapshots"))
    mean = snapshots.groupBy("dof").agg(F.avg("value").alias("mean"), F.count("value").alias("n")).crossJoin(F.broadcast(n))
    kept = mean.filter((F.col("n") >= F.ceil(min_fraction * F.col("n_snapshots"))) & (F.col("n") > 0))
    scale = F.lit(1.0) if weight is None else F.sqrt(F.lit(float(weight)))
    return snapshots.filter("value is not null").join(kept.select("dof", "mean"), "dof").select("snapshot", "dof", ((F.col("value") - F.col("mean")) * scale).alias("x"))


#: Rows of the other side whose products are summed at a time.
CHUNK = 1_024
#: Rows up to which a column is one array whose products Spark sums itself.
DENSE = 64


def _ids(x: DataFrame, row: str, most: int) -> list:
    """The different `row`s, which must be few; no more than that come to the driver."""
    found = x.select(row).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"there are more than the {most} rows that the driver decomposes")
    return sorted(r[0] for r in found)


def gram(x: DataFrame, row: str, col: str, most: int = MOST) -> DataFrame:
    """Inner products of all pairs of `row`s (few) over `col`s (any number): i, j, g with i <= j. Each task sums the
    products of its part of the `col`s; only these sums are shuffled."""
    ids = _ids(x, row, most)
    kind = dict(x.dtypes)[row]
    if len(ids) <= DENSE:
        place = F.transform(F.array(*map(F.lit, ids)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
        summed = x.repartition(col).groupBy(col, row).agg(F.sum("x").alias("x"))
        wide = summed.groupBy(col).agg(F.map_from_entries(F.collect_list(F.struct(row, "x"))).alias("_m")).select(place.alias("_v"))
        pairs = wide.select(F.posexplode("_v").alias("_i", "_x"), "_v").select("_i", F.posexplode(F.transform(F.slice("_v", F.col("_i") + 1, len(ids)), lambda y: y * F.col("_x"))).alias("_k", "_p"))
        name = lambda c: F.get(F.array(*map(F.lit, ids)), c).cast(kind)
        return pairs.groupBy("_i", "_k").agg(F.sum("_p").alias("g")).select(name(F.col("_i")).alias("i"), name(F.col("_i") + F.col("_k")).alias("j"), "g")
    index = {v: k for k, v in enumerate(ids)}

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, rest = np.zeros((len(ids), len(ids))), None

        def add(part: pd.DataFrame) -> None:
            at, of = part[row].map(index).to_numpy(), pd.factorize(part[col])[0]
            for s in range(0, int(of.max()) + 1, CHUNK):
                inside = (of >= s) & (of < s + CHUNK)
                block = np.zeros((CHUNK, len(ids)))
                np.add.at(block, (of[inside] - s, at[inside]), part["x"].to_numpy()[inside])
                g[...] += block.T @ block

        for frame in frames:  # sorted by col; the last one of a batch may go on in the next
            frame = frame if rest is None else pd.concat([rest, frame])
            last = frame[col] == frame[col].iloc[-1]
            rest = frame[last]
            if not last.all():
                add(frame[~last])
        if rest is not None:
            add(rest)
        i, j = np.nonzero(np.triu(g))
        name = np.array(ids, object)
        yield pd.DataFrame({"i": name[i], "j": name[j], "g": g[i, j]})

    parts = x.select(row, col, "x").repartition(col).sortWithinPartitions(col).mapInPandas(products, f"i {kind}, j {kind}, g double")
    return parts.groupBy("i", "j").agg(F.sum("g").alias("g"))


def _square(g: DataFrame, ids: list) -> np.ndarray:
    at = {x: k for k, x in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    for r in g.toLocalIterator():
        m[at[r["i"]], at[r["j"]]] = m[at[r["j"]], at[r["i"]]] = r["g"]
    return m


def decompose(snapshots: DataFrame, modes: int = 20, min_fraction: float = 0.0, weight: float | None = None, drop: float = 1e-12, by: str = "dof") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spectrum (mode, energy, fraction, cumulative), modes (mode, dof, phi) and coefficients (mode, snapshot, a).

    Exact: the smaller of both covariances (by: dof or snapshot) is summed in Spark, and only its eigenvectors are found
    on the driver. Energy is half an eigenvalue of X'X / N. Modes under drop of the total are left out; the entry of
    largest magnitude of each is positive.
    """
    spark = snapshots.sparkSession
    x = cut(fluctuations(snapshots, min_fraction, weight))
    n = snapshots.select("snapshot").distinct().count()
    ids = _ids(x, by, MOST)
    g = _square(gram(x, by, "snapshot" if by == "dof" else "dof"), ids)
    values, vectors = np.linalg.eigh(g / max(n, 1))
    order = [k for k in np.argsort(values)[::-1] if values[k] > drop * max(np.trace(g) / max(n, 1), 0)][:modes]
    total = float(np.trace(g)) / max(n, 1)
    part = [float(values[k]) / total for k in order]
    spectrum = spark.createDataFrame([(i + 1, float(values[k]) / 2, p, float(sum(part[: i + 1]))) for i, (k, p) in enumerate(zip(order, part))], "mode int, energy double, fraction double, cumulative double")
    known = "long" if ids and isinstance(ids[0], int) else "string"
    v = spark.createDataFrame([(i + 1, ids[r], float(vectors[r, k])) for i, k in enumerate(order) for r in range(len(ids))], f"mode int, id {known}, e double")
    other, own = ("snapshot", "dof") if by == "dof" else ("dof", "snapshot")
    projected = x.join(F.broadcast(v), x[own] == v["id"]).groupBy("mode", other).agg(F.sum(F.col("x") * F.col("e")).alias("p"))
    if by == "dof":
        phi, a = v.select("mode", F.col("id").alias("dof"), F.col("e").alias("phi")), projected.select("mode", "snapshot", F.col("p").alias("a"))
    else:
        scale = spark.createDataFrame([(i + 1, float(np.sqrt(values[k] * n))) for i, k in enumerate(order)], "mode int, s double")
        phi = projected.join(F.broadcast(scale), "mode").select("mode", "dof", (F.col("p") / F.col("s")).alias("phi"))
        a = v.join(F.broadcast(scale), "mode").select("mode", F.col("id").alias("snapshot"), (F.col("e") * F.col("s")).alias("a"))
    sign = F.broadcast(phi.groupBy("mode").agg(F.signum(F.max_by("phi", F.struct(F.abs("phi"), -F.col("dof")))).alias("sign")))
    return spectrum, phi.join(sign, "mode").select("mode", "dof", (F.col("phi") * F.col("sign")).alias("phi")), a.join(sign, "mode").select("mode", "snapshot", (F.col("a") * F.col("sign")).alias("a"))


def decompose_randomised(snapshots: DataFrame, modes: int = 20, oversampling: int = 15, iterations: int = 2, min_fraction: float = 0.0, weight: float | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As decompose, for any number of snapshots and dofs: their covariance is looked at through modes + oversampling
    random directions, which power iterations turn towards the strongest modes. Random numbers are hashes of dof and
    seed, so reruns agree. Only squares of the number of directions go to the driver; fractions are of the exact total."""
    spark = snapshots.sparkSession
    x = cut(fluctuations(snapshots, min_fraction, weight))
    n, total = snapshots.select("snapshot").distinct().count(), x.agg(F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0))).first()[0]
    p = modes + oversampling
    unit = lambda j, k: (F.pmod(F.xxhash64("dof", F.lit(seed), F.lit(j), F.lit(k)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    normal = lambda j: F.sqrt(-2 * F.ln(unit(j, 0))) * F.cos(2 * math.pi * unit(j, 1))
    y = x.groupBy("snapshot").agg(F.array(*(F.sum(F.col("x") * normal(j)) for j in range(p))).alias("y"))

    def turned(y: DataFrame, key: str) -> tuple[DataFrame, np.ndarray]:
        """y with orthonormal columns, and the matrix that made them so. Directions that vanish become zero."""
        y = cut(y)
        sums = y.agg(*(F.sum(F.get("y", F.lit(i)) * F.get("y", F.lit(j))) for i in range(p) for j in range(i + 1))).first()
        g, at = np.zeros((p, p)), 0
        for i in range(p):
            for j in range(i + 1):
                g[i, j] = g[j, i] = sums[at] or 0.0
                at += 1
        values, vectors = np.linalg.eigh(g)
        ok = values > 1e-14 * max(values.max(), 1e-300)
        r = vectors * np.where(ok, 1 / np.sqrt(np.where(ok, values, 1.0)), 0.0)
        return _times(y, key, r), r

    def across(q: DataFrame, have: str, want: str) -> DataFrame:
        return x.join(q, have).groupBy(want).agg(F.array(*(F.sum(F.col("x") * F.get("y", F.lit(j))) for j in range(p))).alias("y"))

    q, _ = turned(y, "snapshot")
    for _ in range(iterations):
        z, _ = turned(across(q, "snapshot", "dof"), "dof")
        q, _ = turned(across(z, "dof", "snapshot"), "snapshot")
    b = cut(across(q, "snapshot", "dof"))  # the fluctuations seen from q: its left vectors are mixed into modes
    sums = b.agg(*(F.sum(F.get("y", F.lit(i)) * F.get("y", F.lit(j))) for i in range(p) for j in range(p))).first()
    values, vectors = np.linalg.eigh(np.array([s or 0.0 for s in sums]).reshape(p, p))
    order = [k for k in np.argsort(values)[::-1] if values[k] > 1e-12 * max(total, 1e-300)][:modes]
    part = [float(values[k]) / total for k in order]
    spectrum = spark.createDataFrame([(i + 1, float(values[k]) / max(n, 1) / 2, f, float(sum(part[: i + 1]))) for i, (k, f) in enumerate(zip(order, part))], "mode int, energy double, fraction double, cumulative double")
    root = np.sqrt(values[order])
    phi = _modes(_times(b, "dof", vectors[:, order] / root), "dof", "phi")
    a = _modes(_times(q, "snapshot", vectors[:, order] * root), "snapshot", "a")
    sign = F.broadcast(phi.groupBy("mode").agg(F.signum(F.max_by("phi", F.struct(F.abs("phi"), -F.col("dof")))).alias("sign")))  # a row each mode
    return spectrum, phi.join(sign, "mode").select("mode", "dof", (F.col("phi") * F.col("sign")).alias("phi")), a.join(sign, "mode").select("mode", "snapshot", (F.col("a") * F.col("sign")).alias("a"))


def _times(y: DataFrame, key: str, m: np.ndarray) -> DataFrame:
    """Each row's array times a small matrix."""
    kind = dict(y.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = np.array(f["y"].tolist(), float).reshape(len(f), -1)
            yield pd.DataFrame({key: f[key], "y": list(rows @ m)}) if len(f) else f[[key, "y"]]

    return y.select(key, "y").mapInPandas(run, f"{key} {kind}, y array<double>")


def _modes(y: DataFrame, key: str, name: str) -> DataFrame:
    return y.select(key, F.posexplode("y").alias("mode", name)).withColumn("mode", F.col("mode") + 1)


def reconstruct(modes: DataFrame, coefficients: DataFrame) -> DataFrame:
    """snapshot, dof and the fluctuation that the modes give."""
    # An array of a value for each mode on either side, so that each pair of snapshot and dof is one row, made once: a join
    # by mode would have a row for each mode besides, and all of a mode's rows in one task.
    by = lambda t, key, c: cut(t.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("mode", c))).alias(c)))
    small, large = by(modes, "dof", "phi"), by(coefficients, "snapshot", "a")
    if small.count() > large.count():
        small, large = large, small
    ids = _ids(small.select(F.explode(F.map_keys(small.columns[1])).alias("mode")), "mode", MOST)
    placed = lambda t, c: t.withColumn(c, F.transform(F.array(*map(F.lit, ids)), lambda i: F.try_element_at(c, i)))
    small, large = (placed(t, t.columns[1]) for t in (small, large))
    x = F.aggregate(F.zip_with("a", "phi", lambda p, q: p * q), F.lit(None).cast("double"), lambda s, y: F.coalesce(s + y, s, y))
    return large.crossJoin(F.broadcast(small)).select("snapshot", "dof", x.alias("x")).filter("x is not null")


def mode_gram(modes: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Weighed inner products of modes on their support."""
    m = modes if weights is None else modes.join(weights, "dof")
    m = m.withColumn("x", F.col("phi") * (F.lit(1.0) if weights is None else F.sqrt("weight")))
    return gram(m, "mode", "dof")


def cumulative_energy(spectrum: DataFrame, keys: list[str]) -> DataFrame:
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("mode").rowsBetween(Window.unboundedPreceding, 0)
    return spectrum.withColumn("cumulative", F.sum("fraction").over(w))


def threshold_table(spectrum: DataFrame, keys: list[str], counts: tuple[int, ...] = (1, 2, 5, 10, 20)) -> DataFrame:
    """Energy of the first so many modes, a column for each number."""
    return spectrum.groupBy(*keys).agg(*(F.sum(F.when(F.col("mode") <= k, F.col("fraction"))).alias(f"first_{k}") for k in counts))


def sinusoid_pair(coefficients: DataFrame, frequency: float, first: int = 1, second: int = 2) -> DataFrame:
    """Fit of a sinusoid to two modes' coefficients (mode, t, a): explained share, amplitude and phase of each, and the
    second's phase less the first's in degrees, within -180 and 180."""
    fit = fit_harmonic(coefficients.filter(F.col("mode").isin(first, second)), ["mode"], "a", 2 * math.pi * frequency * F.col("t"))
    one, two = (fit.filter(F.col("mode") == m).select(*(F.col(c).alias(f"{c}_{k}") for c in ("r2", "amplitude", "phase"))) for k, m in ((1, first), (2, second)))
    both = one.crossJoin(two)  # a row each
    turn = F.degrees(F.col("phase_2") - F.col("phase_1"))
    return both.withColumn("difference", F.pmod(turn + 180, F.lit(360.0)) - 180)
