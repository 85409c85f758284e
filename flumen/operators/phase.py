"""Phase averages, harmonics, their quality and convergence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.validity import bin_of, enough, finite, phase_of, valid_flags
from ..sources.fields import VOXEL
from .stats import COMPONENTS


def with_phase(samples: DataFrame, bins: int, frequency: float | None = None, signal: DataFrame | None = None, offset: float = 0.0) -> DataFrame:
    """samples with phase and phase_bin; a signal (ti, phase in radians) goes before a frequency."""
    if signal is not None:
        out = samples.join(signal.select("ti", F.pmod("phase", F.lit(2 * math.pi)).alias("phase")), "ti")
    elif frequency is not None:
        out = samples.withColumn("phase", phase_of(F.col("t"), frequency, offset))
    else:
        raise ValueError("a phase needs a signal or a frequency")
    return out.withColumn("phase_bin", bin_of(F.col("phase"), bins))


def phase_average(phased: DataFrame, mode: str = "nan", mask: str = "component", min_fraction: float = 0.0, u_inf: float | None = None) -> DataFrame:
    """Mean and count of each component for each voxel and bin, and the coherent part: bin mean less the mean of all
    valid samples (which ignores min_fraction). The fraction is of the bin's frames. A row for each component."""
    ok = valid_flags(mode, mask)
    frames = phased.select("volume", "ti", "phase_bin").distinct().groupBy("volume", "phase_bin").agg(F.count("*").alias("bin_frames"))
    long = F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.when(ok[c], F.col(c)).alias("x")) for c in COMPONENTS))).alias("c")
    by = phased.select(*VOXEL, "phase_bin", long).groupBy(*VOXEL, "c.component", "phase_bin").agg(F.sum("c.x").alias("s"), F.count("c.x").alias("n"))
    whole = Window.partitionBy(*VOXEL, "component")
    by = by.withColumn("mean", F.try_divide(F.sum("s").over(whole), F.sum("n").over(whole))).join(frames, ["volume", "phase_bin"])
    out = by.withColumn("phase_mean", F.when(enough(F.col("n"), F.col("bin_frames"), min_fraction), F.col("s") / F.col("n")))
    out = out.select(*VOXEL, "component", "phase_bin", "phase_mean", F.col("n").alias("phase_count"), "bin_frames", "mean", (F.col("phase_mean") - F.col("mean")).alias("coherent"))
    if u_inf is None:
        return out
    deficit = F.when(F.col("component") == "u", (u_inf - F.col("phase_mean")) / u_inf)
    return out.withColumns({"phase_deficit": deficit, "coherent_deficit": F.when(F.col("component") == "u", -F.col("coherent") / u_inf)})


def fit_harmonic(table: DataFrame, keys: list[str], y: str, angle: Column, w: Column | None = None) -> DataFrame:
    """Least squares of y on 1, cos and sin of the angle: offset, a, b, amplitude, phase, n, r2 about the mean of y and
    explained about the offset. Null with fewer than three values or where the three can't be told apart."""
    c, s, v = F.cos(angle), F.sin(angle), F.col(y)
    ok = finite(v) & angle.isNotNull()
    on = lambda x: F.when(ok, x)
    m = table.groupBy(*keys).agg(
        F.count_if(ok).alias("n"), F.avg(on(v)).alias("my"), F.avg(on(c)).alias("mc"), F.avg(on(s)).alias("ms"),
        F.covar_pop(on(c), on(c)).alias("cc"), F.covar_pop(on(s), on(s)).alias("ss"), F.covar_pop(on(c), on(s)).alias("cs"),
        F.covar_pop(on(c), on(v)).alias("cy"), F.covar_pop(on(s), on(v)).alias("sy"), F.var_pop(on(v)).alias("yy"),
    )
    det = F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs")
    fit = (F.col("n") >= 3) & (det > 1e-10)
    a = F.when(fit, (F.col("cy") * F.col("ss") - F.col("sy") * F.col("cs")) / det)
    b = F.when(fit, (F.col("sy") * F.col("cc") - F.col("cy") * F.col("cs")) / det)
    m = m.withColumns({"a": a, "b": b}).withColumn("offset", F.col("my") - F.col("a") * F.col("mc") - F.col("b") * F.col("ms"))
    explained = F.col("a") * F.col("cy") + F.col("b") * F.col("sy")
    r2 = F.when(F.col("yy") > 1e-24, explained / F.col("yy"))
    return m.select(*keys, "n", "offset", "a", "b", F.hypot("a", "b").alias("amplitude"), F.atan2(-F.col("b"), F.col("a")).alias("phase"), r2.alias("r2"), F.col("my").alias("mean"), explained.alias("explained"))


def bin_angle(bins: int) -> Column:
    return (F.col("phase_bin") + 0.5) * (2 * math.pi / bins)


def first_harmonic(averages: DataFrame, bins: int) -> DataFrame:
    return fit_harmonic(averages, [*VOXEL, "component"], "phase_mean", bin_angle(bins))


def coverage(phased: DataFrame, bins: int, iz: int, iy: int, ix: int, min_fraction: float = 0.0) -> DataFrame:
    """Every bin at one voxel: mean, finite samples of the bin's frames, and whether they reach the fraction (one at
    least). The bins that no sample falls into are there as well."""
    here = phased.filter((F.col("iz") == iz) & (F.col("iy") == iy) & (F.col("ix") == ix))
    frames = phased.select("volume", "ti", "phase_bin").distinct().groupBy("volume", "phase_bin").agg(F.count("*").alias("bin_frames"))
    every = phased.select("volume").distinct().crossJoin(phased.sparkSession.range(bins).select(F.col("id").cast("int").alias("phase_bin")))
    by = here.groupBy("volume", "phase_bin").agg(F.count_if(finite(F.col("u"))).alias("n"), F.avg(F.when(finite(F.col("u")), F.col("u"))).alias("u_mean"))
    out = every.join(frames, ["volume", "phase_bin"], "left").join(by, ["volume", "phase_bin"], "left").fillna(0, ["n", "bin_frames"])
    return out.withColumn("accepted", F.col("n") >= F.greatest(F.ceil(min_fraction * F.col("bin_frames")), F.lit(1)))


def all_bins(averages: DataFrame, bins: int, min_fraction: float, strict: bool = False) -> DataFrame:
    """Voxels that every bin covers: with at least the fraction's part of its frames, or strictly more than it."""
    share = F.coalesce(F.try_divide(F.col("phase_count"), F.col("bin_frames")), F.lit(0.0))
    ok = share > min_fraction if strict else F.col("phase_count") >= F.greatest(F.ceil(min_fraction * F.col("bin_frames")), F.lit(1))
    return averages.groupBy(*VOXEL, "component").agg((F.bool_and(ok) & (F.count("*") == bins)).alias("shown"), F.min(share).alias("least_share"))


def quality(phased: DataFrame, averages: DataFrame, bins: int) -> DataFrame:
    """For each voxel and bin of u: mean, sample deviation, standard error, coherent part, residual RMS about the mean."""
    means = averages.filter("component = 'u'").select(*VOXEL, "phase_bin", "phase_mean", "coherent")
    on = F.when(finite(F.col("u")), F.col("u"))
    by = phased.groupBy(*VOXEL, "phase_bin").agg(F.count(on).alias("n"), F.avg(on).alias("mean"), F.stddev_samp(on).alias("std"), F.var_pop(on).alias("_var"))
    about = F.col("_var") + F.pow(F.col("mean") - F.col("phase_mean"), 2)
    out = by.join(means, [*VOXEL, "phase_bin"]).select(*VOXEL, "phase_bin", "n", "mean", "std", "coherent", F.sqrt(about).alias("residual_rms"))
    return out.withColumn("standard_error", F.col("std") / F.sqrt("n"))


def unwrapped(signal: DataFrame, keys: list[str], phase: str = "phase", order: str = "t") -> DataFrame:
    """signal with the phase unwrapped along the order, and the number of whole turns (cycle)."""
    w = Window.partitionBy(*keys).orderBy(order)
    jump = F.coalesce(F.rint((F.col(phase) - F.lag(phase).over(w)) / (2 * math.pi)), F.lit(0.0))
    out = signal.withColumn("_jump", jump).withColumn("unwrapped", F.col(phase) - 2 * math.pi * F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.drop("_jump").withColumn("cycle", F.floor(F.col("unwrapped") / (2 * math.pi)))


def cycle_of(t: Column, frequency: float, offset: float = 0.0) -> Column:
    return F.floor(frequency * t + offset / (2 * math.pi))


def convergence(phased: DataFrame, keys: list[str], frequency: float, offset: float = 0.0) -> DataFrame:
    """Running mean and count by cycle for each key and bin, over every cycle of the record: cycles without data carry
    on, and the coherent part is less the running mean of all bins."""
    ok = finite(F.col("u"))
    by = phased.withColumn("cycle", cycle_of(F.col("t"), frequency, offset)).groupBy(*keys, "phase_bin", "cycle").agg(F.sum(F.when(ok, F.col("u"))).alias("s"), F.count_if(ok).alias("n"))
    ends = by.groupBy(*keys).agg(F.min("cycle").alias("c0"), F.max("cycle").alias("c1"))
    spine = by.select(*keys, "phase_bin").distinct().join(ends, keys).withColumn("cycle", F.explode(F.sequence("c0", "c1"))).drop("c0", "c1")
    full = spine.join(by, [*keys, "phase_bin", "cycle"], "left").fillna(0.0, ["s"]).fillna(0, ["n"])
    so_far = Window.partitionBy(*keys, "phase_bin").orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0)
    run = full.select(*keys, "phase_bin", "cycle", F.sum("s").over(so_far).alias("s"), F.sum("n").over(so_far).alias("n"))
    at_cycle = Window.partitionBy(*keys, "cycle")
    run = run.withColumn("all_mean", F.try_divide(F.sum("s").over(at_cycle), F.sum("n").over(at_cycle))).withColumn("mean", F.try_divide(F.col("s"), F.col("n")))
    return run.select(*keys, "phase_bin", "cycle", "n", "mean", (F.col("mean") - F.col("all_mean")).alias("coherent"))
