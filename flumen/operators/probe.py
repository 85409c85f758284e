"""Point probes: runs, profiles, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.validity import finite


def runs(rows: DataFrame, keys: list[str], order: str, height: str, value: str) -> DataFrame:
    """Rows with a finite value, in runs (run, i) of consecutive rows at one height; a run never spans two keys."""
    w = Window.partitionBy(*keys).orderBy(order)
    numbered = rows.withColumn("_n", F.row_number().over(w))
    good = numbered.filter(finite(F.col(value)) & F.col(height).isNotNull())
    new = (F.col("_n") - F.lag("_n").over(w) != 1) | (F.col(height) != F.lag(height).over(w))
    good = good.withColumn("run", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return good.withColumn("i", F.row_number().over(Window.partitionBy(*keys, "run").orderBy(order)) - 1).drop("_n")


def profile(rows: DataFrame, keys: list[str], value: str, u_ref: float | None = None, absolute: bool = False) -> DataFrame:
    """n, mean (or mean magnitude), sample deviation and intensity in percent; with u_ref also as parts of it."""
    v = F.when(finite(F.col(value)), F.abs(value) if absolute else F.col(value))
    p = rows.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std")).withColumn("intensity", F.try_divide(100 * F.col("std"), F.abs("mean")))
    return p if u_ref is None else p.withColumns({"mean_ref": F.col("mean") / u_ref, "std_ref": F.col("std") / u_ref})


def densities(rows: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """Histogram densities over edges that all keys share; the last bin holds its upper edge."""
    good = rows.filter(finite(F.col(value)))
    ends = good.agg(F.min(value).alias("lo"), ((F.max(value) - F.min(value)) / bins).alias("w"))
    b = F.coalesce(F.least(F.floor(F.try_divide(F.col(value) - F.col("lo"), F.col("w"))), F.lit(bins - 1)), F.lit(0)).cast("int")
    by = good.crossJoin(F.broadcast(ends)).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.max("lo").alias("lo"), F.max("w").alias("w"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return by.select(*keys, "bin", "n", (F.col("lo") + F.col("bin") * F.col("w")).alias("from_"), F.try_divide(F.col("n"), total * F.col("w")).alias("density"))


def paired(profiles: DataFrame, group: str, on: list[str], first: str, second: str, values: list[str]) -> DataFrame:
    """Two groups where both have a value at the same place: each value, difference and percentage of the first."""
    a, b = profiles.filter(F.col(group) == first), profiles.filter(F.col(group) == second)
    both = a.select(*on, *(F.col(v).alias(f"{v}_a") for v in values)).join(b.select(*on, *(F.col(v).alias(f"{v}_b") for v in values)), on)
    return both.withColumns({f"{v}_difference": F.col(f"{v}_b") - F.col(f"{v}_a") for v in values} | {f"{v}_percent": 100 * F.try_divide(F.col(f"{v}_b") - F.col(f"{v}_a"), F.abs(f"{v}_a")) for v in values})


def all_paired(profiles: DataFrame, group: str, on: list[str], values: list[str]) -> DataFrame:
    """As paired, for every two groups: first_<group>, second_<group>. Rows are as many as a place has pairs of groups."""
    a = profiles.select(*on, F.col(group).alias(f"first_{group}"), *(F.col(v).alias(f"{v}_a") for v in values))
    b = profiles.select(*on, F.col(group).alias(f"second_{group}"), *(F.col(v).alias(f"{v}_b") for v in values))
    both = a.join(b, on).filter(F.col(f"first_{group}") < F.col(f"second_{group}"))
    return both.withColumns({f"{v}_difference": F.col(f"{v}_b") - F.col(f"{v}_a") for v in values} | {f"{v}_percent": 100 * F.try_divide(F.col(f"{v}_b") - F.col(f"{v}_a"), F.abs(f"{v}_a")) for v in values})
