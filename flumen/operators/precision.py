"""Two recordings of one field in different precision, sample by sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.validity import component_valid
from ..plans.lineage import cut
from ..plans.order import few
from ..plans.quantile import with_quantiles
from .stats import COMPONENTS

INDICES = ("iz", "iy", "ix")


def matched_axes(a: DataFrame, b: DataFrame, tolerance: float, keys: list[str] = ("axis",)) -> tuple[DataFrame, DataFrame]:
    """Coordinates of two axes tables (keys, idx, coord) that lie within the tolerance of each other: keys, idx, other,
    coord; and what has no partner: keys, side (a or b), idx, coord. Each has one partner at most, the nearest (ties: the
    smallest index), and only if it is the partner's nearest as well. Coordinates meet by cells as wide as the tolerance,
    each with its two neighbours, so it is an equi-join."""
    keys = list(keys)
    cell = F.floor(F.col("coord") / tolerance)
    left = a.select(*keys, "idx", "coord", F.explode(F.array(cell - 1, cell, cell + 1)).alias("_c"))
    right = b.select(*keys, F.col("idx").alias("other"), F.col("coord").alias("_coord"), cell.alias("_c"))
    met = left.join(right, [*keys, "_c"]).withColumn("_d", F.abs(F.col("coord") - F.col("_coord"))).filter(F.col("_d") <= tolerance)
    by_a = met.groupBy(*keys, "idx").agg(F.min(F.struct("_d", "other", "coord")).alias("m")).select(*keys, "idx", F.col("m.other").alias("other"), F.col("m.coord").alias("coord"))
    by_b = met.groupBy(*keys, "other").agg(F.min(F.struct("_d", "idx")).alias("m")).select(*keys, "other", F.col("m.idx").alias("idx"))
    pairs = cut(by_a.join(by_b, [*keys, "idx", "other"]).select(*keys, "idx", "other", "coord"))
    alone = [t.join(pairs.select(*keys, F.col(c).alias("idx")), [*keys, "idx"], "left_anti").select(*keys, F.lit(side).alias("side"), "idx", "coord") for t, side, c in ((a, "a", "idx"), (b, "b", "other"))]
    return pairs, alone[0].unionByName(alone[1])


def within(pairs: DataFrame, box: dict[str, tuple[float, float]]) -> DataFrame:
    """Matched coordinates within centre +- half width of each axis of the box; an axis of which nothing is left is an
    error that names the nearest coordinate."""
    for axis, (centre, half) in box.items():
        on = pairs.filter(F.col("axis") == axis)
        got = on.agg(F.count_if(F.abs(F.col("coord") - centre) <= half).alias("n"), F.min_by("coord", F.abs(F.col("coord") - centre)).alias("near")).first()
        if not got["n"]:
            raise ValueError(f"no {axis} within {half:g} of {centre:g}; the nearest is {got['near']}")
        pairs = pairs.filter((F.col("axis") != axis) | (F.abs(F.col("coord") - centre) <= half))
    return pairs


def compare(double: DataFrame, single: DataFrame, axes_double: DataFrame, axes_single: DataFrame, tolerance: float = 1e-2, box: dict[str, tuple[float, float]] | None = None, mode: str = "nan", sample: list[str] = ("volume", "ti")) -> tuple[DataFrame, DataFrame]:
    """How far two recordings differ: component (or tke), quantity, n, mean, p95, p99, max, and the same relative to the
    first recording's; and the coordinates without a partner (empty where the grids agree), an error row each.

    fluctuation: |a' - b'| over samples valid in both, each about the mean of its own recording's valid samples, relative to
    the RMS of a'. variance: of |var a - var b| over voxels, relative to the mean of var a. count: of valid samples."""
    sample = list(sample)
    pairs, alone = matched_axes(axes_double, axes_single, tolerance)
    pairs = cut(within(pairs, box or {}))
    a, b = double, single
    for i in INDICES:
        one = pairs.filter(F.col("axis") == i[1:])
        a = a.join(few(one.select(F.col("idx").alias(i)), 1_000_000), i, "left_semi")
        b = b.join(few(one.select(F.col("other").alias(i), F.col("idx").alias("_to")), 1_000_000), i).drop(i).withColumnRenamed("_to", i)
    voxel = ["component", *INDICES]

    def valid(t: DataFrame, side: str) -> DataFrame:
        return t.select(*sample, *INDICES, *(F.when(component_valid(F.col(c), mode), F.col(c).cast("double")).alias(f"_{side}_{c}") for c in COMPONENTS))

    def stats(t: DataFrame, side: str) -> DataFrame:
        of = lambda c: F.struct(F.lit(c).alias("component"), F.avg(f"_{side}_{c}").alias(f"m{side}"), F.var_pop(f"_{side}_{c}").alias(f"v{side}"), F.count(f"_{side}_{c}").alias(f"n{side}"))
        by = t.groupBy(*INDICES).agg(*(of(c).alias(c) for c in COMPONENTS))
        return by.select(*INDICES, F.explode(F.array(*COMPONENTS)).alias("e")).select(*INDICES, "e.*")

    a, b = valid(a, "a"), valid(b, "b")
    voxels = cut(stats(a, "a").join(stats(b, "b"), voxel))
    # Both recordings meet once, by sample, with all components in a row; a component's own mean comes with its voxel.
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.col(f"_a_{c}").alias("a"), F.col(f"_b_{c}").alias("b")) for c in COMPONENTS))).alias("e")
    met = a.join(b, [*sample, *INDICES]).select(*INDICES, each).select(*INDICES, "e.*").filter("a is not null and b is not null").join(voxels.select(*voxel, "ma", "mb"), voxel)
    met = cut(met.select("component", (F.col("a") - F.col("ma")).alias("x"), F.abs((F.col("a") - F.col("ma")) - (F.col("b") - F.col("mb"))).alias("d")))
    tke = voxels.groupBy(*INDICES).agg(F.count("*").alias("_n"), *((F.sum(f"v{c}") / 2).alias(f"k{c}") for c in "ab"), *(F.count(f"v{c}").alias(f"_{c}") for c in "ab")).filter("_n = 3 and _a = 3 and _b = 3")
    rows = [
        (met.select("component", F.lit("fluctuation").alias("quantity"), "d"), met.groupBy("component").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("scale")).withColumn("quantity", F.lit("fluctuation"))),
        (voxels.select("component", F.lit("variance").alias("quantity"), F.abs(F.col("va") - F.col("vb")).alias("d")), voxels.groupBy("component").agg(F.avg("va").alias("scale")).withColumn("quantity", F.lit("variance"))),
        (tke.select(F.lit("tke").alias("component"), F.lit("variance").alias("quantity"), F.abs(F.col("ka") - F.col("kb")).alias("d")), tke.agg(F.avg("ka").alias("scale")).select(F.lit("tke").alias("component"), "scale", F.lit("variance").alias("quantity"))),
        (voxels.select("component", F.lit("count").alias("quantity"), F.abs(F.col("na") - F.col("nb")).cast("double").alias("d")), voxels.groupBy("component").agg(F.avg("na").alias("scale")).withColumn("quantity", F.lit("count"))),
    ]
    each, scales = (reduce(DataFrame.unionByName, x) for x in zip(*rows))
    each = each.filter("d is not null")
    keys = ["component", "quantity"]
    by = with_quantiles(each.groupBy(*keys).agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.max("d").alias("max")), each, keys, "d", [0.95, 0.99], "_q").join(scales, keys, "left")
    by = by.select(*keys, "n", "mean", F.get("_q", F.lit(0)).alias("p95"), F.get("_q", F.lit(1)).alias("p99"), "max", "scale")
    # Without a scale differences stay as they are.
    scale = F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)
    return by.select(*keys, "n", *(c for c in ("mean", "p95", "p99", "max")), *((F.col(c) / scale).alias(f"{c}_relative") for c in ("mean", "p95", "p99", "max"))), alone
