"""Several volumes together: joint decomposition, pulsing wakes, surfaces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pod
from .phase import bin_angle, fit_harmonic
from .regrid import align_axis, apply_table, common_support, interpolation_table
from .stats import axis_spacing
from ..functions.validity import finite
from ..plans.lineage import cut
from ..plans.order import few


def phase_snapshots(averages: DataFrame) -> DataFrame:
    """Phase averages (volume, voxel, component, phase_bin, coherent) as snapshots: phase by degree of freedom, blended
    over the volumes that have a value."""
    # The voxel and component themselves, as text: a hash could make two of them one.
    dof = F.concat_ws(",", "iz", "iy", "ix", "component")
    return averages.filter(F.col("coherent").isNotNull()).groupBy(F.col("phase_bin").alias("snapshot"), dof.alias("dof")).agg(F.avg("coherent").alias("value"))


def joint_pod(averages: DataFrame, modes: int = 4, weight: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact decomposition of phase averages of several volumes on one grid; the covariance is that of phases, few by
    nature."""
    return pod.decompose(phase_snapshots(averages), modes, 1.0, weight, by="snapshot")


def on_grid(averages: DataFrame, axes: DataFrame, targets: DataFrame) -> DataFrame:
    """Phase averages of volumes with grids of their own (axes: volume, axis, idx, coord) on common target points
    (target, z, y, x): volume, target, component, phase_bin, coherent. Points outside a volume it doesn't contribute to.
    A volume's interpolation table is made once, for all its components and phases."""
    volumes = axes.groupBy("volume").agg(*(f(F.when(F.col("axis") == a, F.col("coord"))).alias(f"_{a}{n}") for a in "zyx" for f, n in ((F.min, 0), (F.max, 1))))
    # A target meets a volume only within its box.
    inside = reduce(lambda p, q: p & q, (F.col(a).between(F.col(f"_{a}0"), F.col(f"_{a}1")) for a in "zyx"))
    at = targets.join(few(volumes), inside).select("volume", "target", "z", "y", "x")
    table = cut(interpolation_table(axes, at))
    return apply_table(table, averages, ["coherent"], ["component", "phase_bin"])


def uniform_targets(axes: DataFrame, spacing: float | None = None, most: int = 2_000_000) -> DataFrame:
    """Target points (target, z, y, x) of an even grid over all volumes, as far apart along each axis as the coarsest
    volume's median step (or spacing). Refuses more than `most`."""
    spark = axes.sparkSession
    step = axis_spacing(axes).groupBy("axis").agg(F.max("step_median").alias("step"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    by = {r["axis"]: (r["low"], r["high"], spacing or r["step"] or 1.0) for r in step}  # three rows
    counts = {a: int((high - low) / s + 1e-9) + 1 for a, (low, high, s) in by.items()}
    nz, ny, nx = (counts[a] for a in "zyx")
    if nz * ny * nx > most:
        raise ValueError(f"{nz * ny * nx} target points are more than {most}")
    i = F.col("id")
    place = {"z": F.floor(i / (ny * nx)), "y": F.pmod(F.floor(i / nx), F.lit(ny)), "x": F.pmod(i, F.lit(nx))}
    return spark.range(nz * ny * nx).select(i.cast("int").alias("target"), *((by[a][0] + p * by[a][2]).alias(a) for a, p in place.items()))


def joint_pod_on_grid(averages: DataFrame, axes: DataFrame, targets: DataFrame, modes: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decomposition of several volumes' phase averages on common points, blended where volumes overlap; points and
    components that lack a phase are left out."""
    blended = on_grid(averages, axes, targets).groupBy("phase_bin", "target", "component").agg(F.avg("coherent").alias("value"))
    number = F.col("target") * 3 + F.when(F.col("component") == "u", 0).when(F.col("component") == "v", 1).otherwise(2)
    return pod.decompose(blended.select(F.col("phase_bin").alias("snapshot"), number.alias("dof"), "value"), modes, 1.0, by="snapshot")


def source_shares(averages: DataFrame) -> DataFrame:
    """Each volume's part of the coherent energy, where volumes on the same voxel share it."""
    key = ["iz", "iy", "ix", "component", "phase_bin"]
    n = averages.filter(F.col("coherent").isNotNull()).groupBy(*key).agg(F.count("*").alias("n"))
    e = averages.filter(F.col("coherent").isNotNull()).join(n, key).groupBy("volume").agg(F.sum(F.col("coherent") * F.col("coherent") / F.col("n")).alias("energy"))
    total = e.agg(F.sum("energy").alias("total"))
    return e.crossJoin(F.broadcast(total)).select("volume", "energy", F.try_divide("energy", "total").alias("share"))


def pulsing(series: DataFrame, keys: list[str], bins: int, values: tuple[str, ...] = ("mean_deficit", "y", "z")) -> DataFrame:
    """Harmonics over the phase of each value: a row for each key and value; r2 about the fitted offset."""
    long = series.select(*keys, "phase_bin", F.explode(F.array(*(F.struct(F.lit(v).alias("value"), F.col(v).alias("x")) for v in values))).alias("v")).select(*keys, "phase_bin", "v.*")
    fit = fit_harmonic(long, [*keys, "value"], "x", bin_angle(bins))
    both = long.join(fit.select(*keys, "value", "offset", "a", "b"), [*keys, "value"])
    angle = bin_angle(bins)
    rest = F.col("x") - F.col("offset") - F.col("a") * F.cos(angle) - F.col("b") * F.sin(angle)
    r2 = both.filter(finite(F.col("x"))).groupBy(*keys, "value").agg(F.sum(rest * rest).alias("ss"), F.sum(F.pow(F.col("x") - F.col("offset"), 2)).alias("st"))
    return fit.drop("r2").join(r2.select(*keys, "value", F.when(F.col("st") > 1e-24, 1 - F.col("ss") / F.col("st")).alias("r2")), [*keys, "value"])


def common_slab(samples: DataFrame, targets: DataFrame, min_fraction: float) -> DataFrame:
    """Mean u at each x over voxels that every volume covers, after all are brought to the target planes in z."""
    aligned = align_axis(samples, "z", "z", targets, ("u",))
    times = aligned.select("volume", "ti").distinct().groupBy("volume").agg(F.count("*").alias("n_times"))
    by = aligned.groupBy("volume", "iz", "iy", "ix").agg(F.count("u").alias("n"), F.avg("u").alias("u")).join(times, "volume")
    support = common_support(by, ["iz", "iy", "ix"], "volume", min_fraction).filter("support").select("iz", "iy", "ix")
    return by.join(support, ["iz", "iy", "ix"]).groupBy("volume", "ix").agg(F.avg("u").alias("u_mean"), F.count("*").alias("n"))


def surface_points(field: DataFrame, keys: list[str], value: str, level: float, axes: tuple[str, ...] = ("iz", "iy", "ix")) -> DataFrame:
    """Where the level cuts the edges between neighbouring voxels, linearly: the vertices of an isosurface, with the
    axis that the edge runs along."""
    f = field.filter(finite(F.col(value))).select(*keys, *axes, F.col(value).alias("v"))
    ahead = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), *((F.col(b) + (1 if a == b else 0)).alias(f"n_{b}") for b in axes)) for a in axes))).alias("e")
    first = f.select("*", ahead).select(*keys, *axes, "v", "e.axis", *(f"e.n_{b}" for b in axes))
    second = f.select(*keys, *(F.col(b).alias(f"n_{b}") for b in axes), F.col("v").alias("v2"))
    both = first.join(second, [*keys, *(f"n_{b}" for b in axes)]).filter((F.col("v") < level) != (F.col("v2") < level))
    share = (level - F.col("v")) / (F.col("v2") - F.col("v"))
    return both.select(*keys, "axis", *((F.col(b) + share * (F.col(f"n_{b}") - F.col(b))).alias(b) for b in axes))
