"""Masked statistics over time and over the grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.validity import enough, finite, speed, valid_flags
from ..plans.quantile import with_quantiles
from ..sources.fields import VOXEL

COMPONENTS = ("u", "v", "w")
STRESSES = ("uu", "uv", "uw", "vv", "vw", "ww")


def n_times(samples: DataFrame) -> DataFrame:
    return samples.select("volume", "ti").distinct().groupBy("volume").agg(F.count("*").alias("n_times"))


def temporal_mean(samples: DataFrame, mode: str = "nan", mask: str = "component", min_fraction: float = 0.0, u_inf: float | None = None) -> DataFrame:
    """Mean and count of each component at each voxel; a mean needs one valid sample, and the fraction's part of all
    frames. With u_inf: the wake's ratios too."""
    if u_inf is not None and u_inf == 0:
        raise ValueError("u_inf is zero")
    ok = valid_flags(mode, mask)
    sums = samples.groupBy(*VOXEL).agg(*(F.sum(F.when(ok[c], F.col(c))).alias(f"{c}_sum") for c in COMPONENTS), *(F.count_if(ok[c]).alias(f"{c}_count") for c in COMPONENTS))
    sums = sums.join(n_times(samples), "volume")
    mean = lambda c: F.when(enough(F.col(f"{c}_count"), F.col("n_times"), min_fraction), F.col(f"{c}_sum") / F.col(f"{c}_count"))
    out = sums.select(*VOXEL, *(mean(c).alias(f"{c}_mean") for c in COMPONENTS), *(f"{c}_count" for c in COMPONENTS), "n_times")
    out = out.withColumn("speed_from_mean", speed(F.col("u_mean"), F.col("v_mean"), F.col("w_mean")))
    return out if u_inf is None else wake_ratios(out, u_inf)


def wake_ratios(mean: DataFrame, u_inf: float) -> DataFrame:
    ratio = F.col("u_mean") / u_inf
    return mean.withColumns({"u_over_u_inf": ratio, "wake_deficit": (u_inf - F.col("u_mean")) / u_inf, "wake_mask_u09": F.coalesce(ratio < 0.9, F.lit(False))})


def cut_by_fraction(mean: DataFrame, min_fraction: float) -> DataFrame:
    """A stored mean under a stricter fraction: means and speed anew, counts kept, wake ratios left out."""
    out = mean.withColumns({f"{c}_mean": F.when(enough(F.col(f"{c}_count"), F.col("n_times"), min_fraction), F.col(f"{c}_mean")) for c in COMPONENTS})
    out = out.withColumn("speed_from_mean", speed(F.col("u_mean"), F.col("v_mean"), F.col("w_mean")))
    return out.drop("u_over_u_inf", "wake_deficit", "wake_mask_u09")


def _about(mean: Column, average: Column, spread: Column) -> Column:
    """The mean square about a given mean, from average and variance: samples needn't meet their mean."""
    return spread + (average - mean) * (average - mean)


def kinetic_energy(samples: DataFrame, mean: DataFrame, mode: str = "nan", mask: str = "component") -> DataFrame:
    """Population variances about the stored mean, and half their sum where all three are there. One pass over the
    samples; the mean joins what is left of each voxel."""
    ok = valid_flags(mode, mask)
    on = {c: F.when(ok[c], F.col(c)) for c in COMPONENTS}
    by = samples.groupBy(*VOXEL).agg(*(f(on[c]).alias(f"_{c}_{n}") for c in COMPONENTS for f, n in ((F.avg, "avg"), (F.var_pop, "var"), (F.count, "n"))))
    both = by.join(mean.select(*VOXEL, *(f"{c}_mean" for c in COMPONENTS)), VOXEL)
    use = {c: finite(F.col(f"{c}_mean")) for c in COMPONENTS}
    prime2 = (F.when(use[c], _about(F.col(f"{c}_mean"), F.col(f"_{c}_avg"), F.col(f"_{c}_var"))).alias(f"{c}_prime2") for c in COMPONENTS)
    out = both.select(*VOXEL, *prime2, *(F.when(use[c], F.col(f"_{c}_n")).otherwise(0).alias(f"{c}_prime2_count") for c in COMPONENTS))
    return out.withColumn("tke", 0.5 * (F.col("u_prime2") + F.col("v_prime2") + F.col("w_prime2")))


def reynolds_stresses(samples: DataFrame, mean: DataFrame, which: tuple[str, ...] = ("all",), mode: str = "nan", mask: str = "component") -> DataFrame:
    """Means of products of fluctuations, over samples where both are valid; one pass, as for the energy."""
    which = tuple(dict.fromkeys(which))
    if "all" in which and len(which) > 1 or not set(which) <= {*STRESSES, "all"}:
        raise ValueError(f"stresses are some of {STRESSES}, or all")
    which = STRESSES if "all" in which else which
    ok = valid_flags(mode, mask)
    on = lambda a, b, c: F.when(ok[a] & ok[b], F.col(c))
    by = samples.groupBy(*VOXEL).agg(*(x for a, b in which for x in (
        F.covar_pop(on(a, b, a), on(a, b, b)).alias(f"_{a}{b}_cov"), F.avg(on(a, b, a)).alias(f"_{a}{b}_a"), F.avg(on(a, b, b)).alias(f"_{a}{b}_b"), F.count(on(a, b, a)).alias(f"_{a}{b}_n"),
    )))
    both = by.join(mean.select(*VOXEL, *(f"{c}_mean" for c in COMPONENTS)), VOXEL)
    use = lambda a, b: finite(F.col(f"{a}_mean")) & finite(F.col(f"{b}_mean"))
    product = lambda a, b: F.col(f"_{a}{b}_cov") + (F.col(f"_{a}{b}_a") - F.col(f"{a}_mean")) * (F.col(f"_{a}{b}_b") - F.col(f"{b}_mean"))
    return both.select(*VOXEL, *(F.when(use(a, b), product(a, b)).alias(f"{a}{b}_stress") for a, b in which), *(F.when(use(a, b), F.col(f"_{a}{b}_n")).otherwise(0).alias(f"{a}{b}_count") for a, b in which))


def moments(samples: DataFrame, keys: list[str] = VOXEL, mode: str = "nan", mask: str = "vector", u_ref: float | None = None, min_count: int = 2, min_speed: float = 0.0) -> DataFrame:
    """Mean, population RMS and count of each component by keys, and turbulence intensity in percent of |mean u| or of
    u_ref. Spark merges partial moments pairwise."""
    ok = valid_flags(mode, mask)
    out = samples.groupBy(*keys).agg(*(f(F.when(ok[c], F.col(c))).alias(f"{c}_{n}") for c in COMPONENTS for f, n in ((F.avg, "mean"), (F.stddev_pop, "rms"), (F.count, "count"))))
    base = F.abs(F.col("u_mean")) if u_ref is None else F.lit(float(u_ref))
    return out.withColumns({f"{c}_ti": F.when((F.col(f"{c}_count") >= min_count) & finite(base) & (base > min_speed), 100 * F.col(f"{c}_rms") / base) for c in COMPONENTS})


def plane_profiles(mean: DataFrame, energy: DataFrame) -> DataFrame:
    """For each index along each axis: means over the plane of mean velocities, variances and energy; intensity."""
    both = mean.join(energy, VOXEL)
    good = lambda c: F.avg(F.when(finite(F.col(c)), F.col(c)))
    sets = both.groupingSets([[F.col("volume"), F.col(i)] for i in ("ix", "iy", "iz")], "volume", "ix", "iy", "iz").agg(
        F.grouping_id().alias("gid"), good("u_mean").alias("u_mean"), good("v_mean").alias("v_mean"), good("w_mean").alias("w_mean"), good("u_prime2").alias("u_var"), good("tke").alias("tke"), F.count_if(finite(F.col("u_mean"))).alias("n")
    )
    axis = F.when(F.col("ix").isNotNull(), "x").when(F.col("iy").isNotNull(), "y").otherwise("z")
    return sets.select("volume", axis.alias("axis"), F.coalesce("ix", "iy", "iz").alias("idx"), "n", "u_mean", "v_mean", "w_mean", "u_var", "tke", F.try_divide(F.sqrt("u_var"), F.abs("u_mean")).alias("ti"))


def blocks(samples: DataFrame, mean: DataFrame, n: int, first: int, last: int, min_fraction: float = 0.0) -> DataFrame:
    """Stationarity: the record from index first to last in n blocks. For each, over voxels with at least two and the
    fraction's part of the block's frames: mean of the block's mean less the record's, and of its own variance."""
    edges = [first + round(i * (last + 1 - first) / n) for i in range(n + 1)]
    e = F.array(*map(F.lit, edges))
    block = F.size(F.filter(e, lambda x: x <= F.col("ti"))) - 1
    ok = finite(F.col("u"))
    by = samples.filter(F.col("ti").between(first, last)).withColumn("block", block).groupBy("block", *VOXEL)
    by = by.agg(F.avg(F.when(ok, F.col("u"))).alias("_u"), F.var_pop(F.when(ok, F.col("u"))).alias("var"), F.count_if(ok).alias("n"), F.count_distinct("ti").alias("frames"))
    by = by.join(mean.select(*VOXEL, "u_mean"), VOXEL).withColumn("shift", F.col("_u") - F.col("u_mean"))
    by = by.filter((F.col("n") >= 2) & (F.col("n") >= F.ceil(min_fraction * F.col("frames"))))
    return by.groupBy("volume", "block").agg(F.count("*").alias("n_voxels"), F.avg("shift").alias("mean_shift"), F.avg("var").alias("mean_var"))


def frame_stats(samples: DataFrame) -> DataFrame:
    """Least and most of each component and speed's mean and most, over finite values of each frame."""
    val = lambda c: F.when(finite(F.col(c)), F.col(c))
    s = speed(val("u"), val("v"), val("w"))
    return samples.groupBy("volume", "ti").agg(*(f(val(c)).alias(f"{c}_{n}") for c in COMPONENTS for f, n in ((F.min, "min"), (F.max, "max"))), F.avg(s).alias("speed_mean"), F.max(s).alias("speed_max"))


def plane_stats(field: DataFrame, value: str, keys: list[str]) -> DataFrame:
    ok = F.when(finite(F.col(value)), F.col(value))
    return field.groupBy(*keys).agg(F.avg(ok).alias("mean"), F.stddev_pop(ok).alias("std"), F.count(ok).alias("n"))


def difference_stats(pairs: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Mean, 95th and 99th percentile and most of |a - b|."""
    d = F.abs(F.col(a) - F.col(b))
    d = F.when(finite(d), d)
    by = pairs.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.max(d).alias("max"))
    q = lambda i: F.get("_q", F.lit(i))
    return with_quantiles(by, pairs, keys, d, [0.95, 0.99], "_q").select(*keys, "n", "mean", q(0).alias("p95"), q(1).alias("p99"), "max")


def axis_spacing(axes: DataFrame, rtol: float = 0.002) -> DataFrame:
    """Of the coords of each volume and axis: number, ends, and spacing; uniform within rtol of the median spacing."""
    order = Window.partitionBy("volume", "axis").orderBy("coord")
    steps = axes.withColumn("step", F.col("coord") - F.lag("coord").over(order))
    out = steps.groupBy("volume", "axis").agg(F.count("*").alias("n"), F.min("coord").alias("low"), F.max("coord").alias("high"), F.median("step").alias("step_median"), F.min("step").alias("step_min"), F.max("step").alias("step_max"))
    return out.withColumn("uniform", F.coalesce((F.col("step_max") - F.col("step_min")) <= 2 * rtol * F.abs("step_median"), F.lit(True)))


def coverage_at(samples: DataFrame, mode: str = "nan", min_fraction: float = 0.0) -> DataFrame:
    """Mean, count and acceptance of each component at each voxel, a row for each component."""
    m = temporal_mean(samples, mode, "component", 0.0)
    long = m.select(*VOXEL, "n_times", F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.col(f"{c}_mean").alias("mean"), F.col(f"{c}_count").alias("count")) for c in COMPONENTS))).alias("x")).select(*VOXEL, "n_times", "x.*")
    return long.withColumn("accepted", enough(F.col("count"), F.col("n_times"), min_fraction))


def limits(field: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Shared limits for a quantity: 1st and 99th percentile, ends, and the largest magnitude."""
    ok = F.when(finite(F.col(value)), F.col(value))
    by = field.groupBy(*keys).agg(F.min(ok).alias("low"), F.max(ok).alias("high"), F.max(F.abs(ok)).alias("most"))
    q = lambda i: F.get("_q", F.lit(i))
    return with_quantiles(by, field, keys, ok, [0.01, 0.99], "_q").select(*keys, q(0).alias("p01"), q(1).alias("p99"), "low", "high", "most")


def weighted(field: DataFrame, values: list[str], weight: str, keys: list[str]) -> DataFrame:
    """Weighted means; one that meets a value that is not finite is withheld."""

    def one(v: str) -> Column:
        ok = F.bool_and(finite(F.col(v)))
        return F.when(ok, F.try_divide(F.sum(F.col(v) * F.col(weight)), F.sum(weight)))

    return field.groupBy(*keys).agg(*(one(v).alias(v) for v in values))
