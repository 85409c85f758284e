"""Two-point correlations and integral scales."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_moments(table: DataFrame, line: list[str], index: str, value: str, max_lag: int, pool: list[str]) -> DataFrame:
    """For each lag up to max_lag, over all pairs of valid values so far apart along their line: n, and sums of ab, aa,
    bb, pooled. Every value meets the max_lag + 1 ones after it: rows grow with the table, not with its square."""
    good = table.filter(F.col(value).isNotNull()).select(*line, *(p for p in pool if p not in line), F.col(index).alias("_at"), F.col(value).alias("_x"))
    lags = F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag")
    first = good.select("*", lags).withColumn("_at", F.col("_at") + F.col("lag")).withColumnRenamed("_x", "a")
    second = good.select(*line, "_at", F.col("_x").alias("b"))
    both = first.join(second, [*line, "_at"])
    return both.groupBy(*pool, "lag").agg(F.count("*").alias("n"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))


def normalised(moments: DataFrame, pool: list[str], min_pairs: int = 1, min_fraction: float = 0.0) -> DataFrame:
    """rho at each lag, within [-1, 1]; null with too few pairs (of the number at lag 0) or no variance."""
    w = Window.partitionBy(*pool) if pool else Window.partitionBy(F.lit(0))
    n0 = F.max(F.when(F.col("lag") == 0, F.col("n"))).over(w)
    ok = (F.col("n") >= F.greatest(F.lit(float(min_pairs)), n0 * min_fraction)) & (F.col("aa") * F.col("bb") > 0)
    rho = F.when(ok, F.least(F.greatest(F.try_divide(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb"))), F.lit(-1.0)), F.lit(1.0)))
    return moments.select(*pool, "lag", "n", rho.alias("rho"))


def integral_scale(rho: DataFrame, pool: list[str], spacing: float = 1.0) -> DataFrame:
    """Trapezoid of rho up to its first zero, found linearly: scale and zero. Without one the scale is null, truncated
    is the integral over what is there, and status says why."""
    w = (Window.partitionBy(*pool) if pool else Window.partitionBy(F.lit(0))).orderBy("lag")
    r = rho.withColumn("next", F.lead("rho").over(w)).withColumn("bad", F.max(F.col("rho").isNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("gap_next", F.col("next").isNull() & (F.lead("lag").over(w).isNotNull()))
    crosses = (F.col("rho") > 0) & (F.col("next") <= 0)
    r = r.withColumn("crossing", F.when((F.col("bad") == 0) & crosses, F.col("lag")))
    first = F.min("crossing").over((Window.partitionBy(*pool) if pool else Window.partitionBy(F.lit(0))))
    r = r.withColumn("first", first)
    share = F.try_divide(F.col("rho"), F.col("rho") - F.col("next"))
    step = F.when(F.col("lag") == F.col("first"), F.col("rho") * share / 2).when((F.col("bad") == 0) & F.col("next").isNotNull() & (F.col("first").isNull() | (F.col("lag") < F.col("first"))), (F.col("rho") + F.col("next")) / 2)
    zero = F.when(F.col("lag") == F.col("first"), F.col("lag") + share)
    out = r.groupBy(*pool).agg((F.sum(step) * spacing).alias("integral"), (F.max(zero) * spacing).alias("zero"), F.max("bad").alias("bad"), F.min("lag").alias("lag0"), F.max(F.when(F.col("lag") == 0, F.col("rho"))).alias("rho0"))
    status = F.when(F.col("zero").isNotNull(), "first_zero_crossing").when(F.col("rho0").isNull(), "insufficient_pairs_or_zero_variance").when(F.col("bad") == 1, "insufficient_pairs_before_zero").otherwise("no_zero_crossing")
    found = F.col("zero").isNotNull()
    return out.select(*pool, F.when(found, F.col("integral")).alias("scale"), "zero", F.when(~found, F.col("integral")).alias("truncated"), status.alias("status"))


def taylor_length(scale_s: float, mean_u: float) -> float:
    """Length of an eddy from its time scale and the speed that carries it."""
    return abs(mean_u) * scale_s
