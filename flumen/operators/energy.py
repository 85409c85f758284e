"""Energy of fluctuations that forcing explains, with cross-validation over cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.validity import finite
from ..plans.order import few
from .phase import bin_angle, cycle_of, fit_harmonic


def budget(phased: DataFrame, keys: list[str], value: str, bins: int, frequency: float, offset: float = 0.0, min_samples: int = 1) -> DataFrame:
    """For each key, half variances of the value: total; explained by a harmonic of the phase; by one fitted to bin
    means with equal weights; phase-locked (between bins); residual (within). And the mean squared errors, halved, of
    predicting each cycle from the others: from their bin means, and from their mean.

    Sums by key, cycle and bin suffice: a left-out cycle's squared error is its sum of squares less twice its sums times
    the others' means plus its counts times their squares. A key needs three values and min_samples in each bin; a
    cross-validation is null where leaving a cycle out empties a bin.
    """
    v = F.col(value)
    good = phased.filter(finite(v)).withColumn("cycle", cycle_of(F.col("t"), frequency, offset))
    cells = good.groupBy(*keys, "phase_bin", "cycle").agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    by_bin = cells.groupBy(*keys, "phase_bin").agg(F.sum("n").alias("bn"), F.sum("s").alias("bs"))
    by_key = cells.groupBy(*keys).agg(F.sum("n").alias("kn"), F.sum("s").alias("ks"), F.sum("q").alias("kq"))
    by_cycle = cells.groupBy(*keys, "cycle").agg(F.sum("n").alias("cn"), F.sum("s").alias("cs"), F.sum("q").alias("cq"))
    locked = by_bin.join(by_key, keys).groupBy(*keys).agg(
        F.max("kn").alias("n"), F.count("*").alias("n_bins"), F.min("bn").alias("least"),
        (F.max(F.col("kq") / F.col("kn") - F.pow(F.col("ks") / F.col("kn"), 2)) / 2).alias("total"),
        (F.sum(F.col("bn") * F.pow(F.col("bs") / F.col("bn") - F.col("ks") / F.col("kn"), 2)) / F.max("kn") / 2).alias("locked"),
    )
    sse = lambda n, s, q, mean: q - 2 * mean * s + n * mean * mean
    rest = F.try_divide(F.col("bs") - F.col("s"), F.col("bn") - F.col("n"))
    cv_phase = cells.join(by_bin, [*keys, "phase_bin"]).groupBy(*keys).agg(F.bool_and(F.col("bn") > F.col("n")).alias("_p"), F.sum(sse(F.col("n"), F.col("s"), F.col("q"), rest)).alias("_ps"), F.sum("n").alias("_pn"))
    left = F.try_divide(F.col("ks") - F.col("cs"), F.col("kn") - F.col("cn"))
    cv_mean = by_cycle.join(by_key, keys).groupBy(*keys).agg(F.bool_and(F.col("kn") > F.col("cn")).alias("_m"), F.sum(sse(F.col("cn"), F.col("cs"), F.col("cq"), left)).alias("_ms"))
    harmonic = fit_harmonic(good, keys, value, F.col("phase")).select(*keys, (F.col("explained") / 2).alias("forcing"))
    means = by_bin.withColumn("bm", F.col("bs") / F.col("bn"))
    uniform = fit_harmonic(means, keys, "bm", bin_angle(bins)).select(*keys, (0.25 * (F.col("a") * F.col("a") + F.col("b") * F.col("b"))).alias("uniform"))
    out = locked.join(harmonic, keys, "left").join(uniform, keys, "left").join(cv_phase, keys).join(cv_mean, keys)
    ok = (F.col("n") >= 3) & (F.col("n_bins") == bins) & (F.col("least") >= min_samples)
    on: dict[str, Column] = {c: F.when(ok, F.col(c)) for c in ("total", "forcing", "uniform", "locked")}
    on |= {"residual": F.when(ok, F.col("total") - F.col("locked")), "cv_phase": F.when(ok & F.col("_p"), F.col("_ps") / F.col("_pn") / 2), "cv_mean": F.when(ok & F.col("_m"), F.col("_ms") / F.col("_pn") / 2)}
    return out.select(*keys, "n", *(c.alias(k) for k, c in on.items()))


BUDGET = ("total", "forcing", "uniform", "locked", "residual", "cv_phase", "cv_mean")


def slab_budget(voxels: DataFrame, cells: DataFrame, slabs: DataFrame, names: tuple[str, ...] = BUDGET) -> DataFrame:
    """Budgets of voxels (volume, ix, names) reduced over slabs of x (slab, from_, to), each voxel weighed by how much of
    its cell (volume, idx, low, high) lies in the slab; n voxels. Voxels without a budget are left out."""
    weights = slab_weights(cells, slabs).select("volume", F.col("idx").alias("ix"), "slab", "weight")
    met = voxels.filter("total is not null").join(weights, ["volume", "ix"])
    # Weighted means by slab; one that meets a value that is missing is withheld.
    mean = lambda c: F.when(F.bool_and(finite(F.col(c))), F.try_divide(F.sum(F.col(c) * F.col("weight")), F.sum("weight")))
    return met.groupBy("volume", "slab").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), *(mean(c).alias(c) for c in names))


def candidates(samples: DataFrame, value: str, min_fraction: float, **window: tuple[float, float]) -> DataFrame:
    """samples of the voxels within a window (bounds of any columns) that have a valid value in at least the fraction's
    part of all frames: those a budget is worth working out for."""
    n = samples.select("volume", "ti").distinct().groupBy("volume").agg(F.count("*").alias("_frames"))
    inside = samples
    for name, (low, high) in window.items():
        inside = inside.filter(F.col(name).between(low, high))
    voxel = ["volume", "iz", "iy", "ix"]
    enough = inside.groupBy(*voxel).agg(F.count_if(finite(F.col(value))).alias("_n")).join(n, "volume").filter(F.col("_n") >= F.ceil(min_fraction * F.col("_frames")))
    return inside.join(enough.select(*voxel), voxel, "left_semi")


def overlap(low: Column, high: Column, from_: Column, to: Column) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.least(high, to) - F.greatest(low, from_), F.lit(0.0))


def slab_weights(cells: DataFrame, slabs: DataFrame) -> DataFrame:
    """cells (volume, idx, low, high) joined with the slabs (slab, from_, to) that they overlap, and by how much. Slabs
    are a handful; cells of an axis as well."""
    w = overlap(F.col("low"), F.col("high"), F.col("from_"), F.col("to"))
    return cells.join(few(slabs), (F.col("high") > F.col("from_")) & (F.col("low") < F.col("to"))).withColumn("weight", w)
