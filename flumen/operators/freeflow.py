"""Characterisation of a free flow: correlations of all components along all axes and in time, and their scales."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.validity import finite
from ..sources.fields import VOXEL
from .correlation import integral_scale, normalised, pair_moments
from .stats import COMPONENTS

AXES = ("x", "y", "z")


def fluctuations(samples: DataFrame, mean: DataFrame) -> DataFrame:
    """A row for each sample and component: value less the voxel's mean, where both are finite."""
    long = F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.col(c).alias("value")) for c in COMPONENTS))).alias("c")
    values = samples.select(*VOXEL, "ti", long).select(*VOXEL, "ti", "c.*").filter(finite(F.col("value")))
    means = F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.col(f"{c}_mean").alias("mean")) for c in COMPONENTS))).alias("m")
    known = mean.select(*VOXEL, means).select(*VOXEL, "m.*").filter(finite(F.col("mean")))
    return values.join(known, [*VOXEL, "component"]).select(*VOXEL, "ti", "component", (F.col("value") - F.col("mean")).alias("prime"))


def spatial_correlations(primes: DataFrame, max_lag: int, min_pairs: int = 1) -> DataFrame:
    """volume, component, axis, lag, n, rho: each component along each axis, over all frames and lines."""
    parts = []
    for a in AXES:
        others = [f"i{b}" for b in AXES if b != a]
        moments = pair_moments(primes, ["volume", "component", "ti", *others], f"i{a}", "prime", max_lag, ["volume", "component"])
        parts.append(moments.withColumn("axis", F.lit(a)))
    return normalised(reduce(DataFrame.unionByName, parts), ["volume", "component", "axis"], min_pairs)


def temporal_correlations(primes: DataFrame, probe: tuple[int, int, int], max_lag: int, min_pairs: int = 1) -> DataFrame:
    """volume, component, lag, n, rho at one voxel (iz, iy, ix), over frames."""
    here = primes.filter(reduce(lambda a, b: a & b, (F.col(c) == i for c, i in zip(("iz", "iy", "ix"), probe))))
    return normalised(pair_moments(here, ["volume", "component"], "ti", "prime", max_lag, ["volume", "component"]), ["volume", "component"], min_pairs)


def scales(spatial: DataFrame, temporal: DataFrame, mean: DataFrame, probe: tuple[int, int, int], spacing: float = 1.0, time_step: float = 1.0) -> DataFrame:
    """volume, component, axis (x, y, z or t), scale, zero, truncated, status, and for t the length of the eddies that the
    probe's mean u carries past in that time."""
    pool = ["volume", "component", "axis"]
    lengths = integral_scale(spatial, pool, spacing).withColumn("length", F.col("scale"))
    times = integral_scale(temporal.withColumn("axis", F.lit("t")), pool, time_step)
    at = mean.filter(reduce(lambda a, b: a & b, (F.col(c) == i for c, i in zip(("iz", "iy", "ix"), probe)))).select("volume", F.abs("u_mean").alias("_speed"))
    times = times.join(at, "volume", "left").withColumn("length", F.col("scale") * F.col("_speed")).drop("_speed")
    return lengths.unionByName(times)


def any_filled(samples: DataFrame, flags: tuple[str, ...] = ("u_filled", "v_filled", "w_filled")) -> DataFrame:
    """samples with filled: whether any component was. Flags that samples lack count as not filled."""
    there = [F.coalesce(F.col(f), F.lit(False)) for f in flags if f in samples.columns]
    return samples.withColumn("filled", reduce(lambda a, b: a | b, there, F.lit(False)))
