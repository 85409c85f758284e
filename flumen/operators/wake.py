"""Reductions of wakes: radial, integrated, by slab and by sector; centres and lines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.validity import finite
from ..plans.order import few
from ..sources.fields import nearest_index


def disc(y: Column, z: Column, radius: float, y0: float = 0.0, z0: float = 0.0) -> Column:
    return F.pow(y - y0, 2) + F.pow(z - z0, 2) <= radius * radius


def line(y: Column, iz: Column, row: int, radius: float, y0: float = 0.0) -> Column:
    return (iz == row) & (F.abs(y - y0) <= radius)


def sector_share(y: Column, z: Column, dy: Column, dz: Column, radius: float, start: float, span: float, cells: int = 16) -> Column:
    """Area of each cell within a disc's sector (degrees from start on), by midpoints of cells x cells parts."""
    steps = F.sequence(F.lit(0), F.lit(cells - 1))
    at = lambda c, d, i: c + d * ((i + 0.5) / cells - 0.5)

    def inside(yy: Column, zz: Column) -> Column:
        angle = F.pmod(F.degrees(F.atan2(zz, yy)) - start, F.lit(360.0))
        return ((yy * yy + zz * zz <= radius * radius) & (angle <= span)).cast("double")

    rows = F.transform(steps, lambda i: F.aggregate(F.transform(steps, lambda j: inside(at(y, dy, i), at(z, dz, j))), F.lit(0.0), lambda s, v: s + v))
    return F.aggregate(rows, F.lit(0.0), lambda s, v: s + v) * dy * dz / (cells * cells)


def sector_area(radius: float, span: float) -> float:
    return radius * radius / 2 * math.radians(span)


def radial_average(cells: DataFrame, keys: list[str], r: str, value: str, width: float) -> DataFrame:
    """Mean and count over half-open rings of a width. The last edge is the largest multiple of the width below the
    largest radius plus a width, and what lies on it or beyond is left out. Rings without cells have none."""
    top = cells.agg(F.max(r).alias("top")).withColumn("n_bins", (F.ceil((F.col("top") + width) / width) - 1).cast("int"))
    binned = cells.crossJoin(F.broadcast(top)).withColumn("ring", F.floor(F.col(r) / width).cast("int")).filter(F.col("ring") < F.col("n_bins"))
    ok = finite(F.col(value))
    return binned.groupBy(*keys, "ring").agg(F.avg(F.when(ok, F.col(value))).alias("mean"), F.count_if(ok).alias("n"))


def profile(mean: DataFrame, axes: DataFrame, along: str, at: dict[str, float], u_inf: float, diameter: float, x: float | None = None) -> DataFrame:
    """A plane's or line's deficit: volume, coordinate along an axis in diameters, deficit; at the indices nearest to the
    given places of other axes (at), and to x. axes: volume, axis, idx, coord."""
    picked = mean
    for axis, place in {**at, **({} if x is None else {"x": x})}.items():
        index = nearest_index(axes.filter(F.col("axis") == axis), place).select("volume", F.col("idx").alias(f"i{axis}"))
        picked = picked.join(index, ["volume", f"i{axis}"], "left_semi")
    coords = axes.filter(F.col("axis") == along).select("volume", F.col("idx").alias(f"i{along}"), (F.col("coord") / diameter).alias("coordinate"))
    out = picked.join(coords, ["volume", f"i{along}"])
    return out.select("volume", *(f"i{a}" for a in "zyx"), "coordinate", ((u_inf - F.col("u_mean")) / u_inf).alias("deficit"))


def gated(rows: DataFrame, keys: list[str], x: str, target: float, r2: str, min_r2: float) -> DataFrame:
    """What may be shown of harmonics: for each key the slice nearest to a place, and of it what is explained strictly
    better than a minimum."""
    known = rows.groupBy(*keys).agg(F.min_by(x, F.struct(F.abs(F.col(x) - target), F.col(x))).alias("_x"))
    return rows.join(known, keys).filter((F.col(x) == F.col("_x")) & (F.col(r2) > min_r2)).drop("_x")


def about_phase_mean(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """value less its mean over all phases of a key."""
    means = rows.groupBy(*keys).agg(F.avg(value).alias("_m"))
    return rows.join(means, keys).withColumn(value, F.col(value) - F.col("_m")).drop("_m")


def visible_phase(rows: DataFrame, keys: list[str], amplitude: str, phase: str, part: float = 0.01) -> DataFrame:
    """The phase, null where the amplitude is below a part of the key's largest."""
    top = rows.groupBy(*keys).agg(F.max(amplitude).alias("_top"))
    return rows.join(top, keys).withColumn(phase, F.when(F.col(amplitude) >= part * F.col("_top"), F.col(phase))).drop("_top")


def integrated(cells: DataFrame, keys: list[str], value: str, region: Column | None = None) -> DataFrame:
    """Mean over valid cells of a region, cells alike."""
    ok = finite(F.col(value)) & (region if region is not None else F.lit(True))
    return cells.groupBy(*keys).agg(F.avg(F.when(ok, F.col(value))).alias("mean"), F.count_if(ok).alias("n"))


def integrated_by_slice(cells: DataFrame, value: str, min_fraction: float, edge: int = 0) -> DataFrame:
    """Mean over each x slice of a volume; without `edge` slices at both ends, and null where a slice has less than the
    fraction's part of the largest number of cells."""
    by = integrated(cells, ["volume", "ix"], value)
    w = Window.partitionBy("volume")
    by = by.withColumns({"most": F.max("n").over(w), "low": F.min("ix").over(w), "high": F.max("ix").over(w)})
    by = by.filter((F.col("ix") >= F.col("low") + edge) & (F.col("ix") <= F.col("high") - edge))
    return by.select("volume", "ix", "n", F.when(F.col("n") >= F.ceil(min_fraction * F.col("most")), F.col("mean")).alias("mean"))


def slab_mean(mean: DataFrame, min_fraction: float) -> DataFrame:
    """u at each x, over voxels of which strictly more than the fraction of frames is valid."""
    ok = (F.try_divide(F.col("u_count"), F.col("n_times")) > min_fraction) & finite(F.col("u_mean"))
    return mean.groupBy("volume", "ix").agg(F.avg(F.when(ok, F.col("u_mean"))).alias("u_mean"), F.count_if(ok).alias("n"))


def nearest_plane(slices: DataFrame, x: str, target: float) -> DataFrame:
    """The rows of the slice nearest to a place, by volume; the first of equally near ones."""
    known = slices.groupBy("volume").agg(F.min_by(x, F.struct(F.abs(F.col(x) - target), F.col(x))).alias("_x"))
    return slices.join(known, "volume").filter(F.col(x) == F.col("_x")).drop("_x")


def centre(cells: DataFrame, keys: list[str], deficit: str, area: Column, y: str = "y", z: str = "z") -> DataFrame:
    """Centre of the positive deficit, weighed by it and by area."""
    w = F.when(finite(F.col(deficit)) & (F.col(deficit) > 0), F.col(deficit) * area)
    return cells.groupBy(*keys).agg(F.try_divide(F.sum(w * F.col(y)), F.sum(w)).alias("y"), F.try_divide(F.sum(w * F.col(z)), F.sum(w)).alias("z"), F.sum(w).alias("strength"))


def fixed_support(cells: DataFrame, keys: list[str], cell: list[str], phase: str, deficit: str, area: str, phases: int) -> DataFrame:
    """For each phase, over cells that are valid at every phase: area-weighed mean deficit and centre of its positive
    part, and the share of the area that is covered."""
    ok = finite(F.col(deficit))
    held = cells.groupBy(*keys, *cell).agg((F.count_if(ok) == phases).alias("held"), F.max(area).alias("_a"))
    share = held.groupBy(*keys).agg(F.try_divide(F.sum(F.when(F.col("held"), F.col("_a"))), F.sum("_a")).alias("coverage"))
    on = cells.join(held.filter("held").select(*keys, *cell), [*keys, *cell])
    w = F.when(F.col(deficit) > 0, F.col(deficit) * F.col(area))
    out = on.groupBy(*keys, phase).agg(F.try_divide(F.sum(F.col(deficit) * F.col(area)), F.sum(area)).alias("mean_deficit"), F.try_divide(F.sum(w * F.col("y")), F.sum(w)).alias("y"), F.try_divide(F.sum(w * F.col("z")), F.sum(w)).alias("z"))
    return out.join(share, keys)


def outside_earlier(cells: DataFrame, order: str, names: tuple[str, ...] = ("x",)) -> DataFrame:
    """cells (volume, order, coordinates) without those that lie within the extent (inclusive, along all names) of a
    volume of lower order. Extents are as many as volumes."""
    ext = cells.groupBy(F.col("volume").alias("_v"), F.col(order).alias("_o")).agg(*(f(n).alias(f"_{n}{k}") for n in names for f, k in ((F.min, 0), (F.max, 1))))
    hit = F.col(order) > F.col("_o")
    for n in names:
        hit = hit & F.col(n).between(F.col(f"_{n}0"), F.col(f"_{n}1"))
    return cells.join(few(ext), hit, "left_anti")


def straight_line(points: DataFrame, keys: list[str], x: str, y: str, trim: float = 0.0) -> DataFrame:
    """Least-squares line for each key and for all points together (keys null): slope, intercept, r2 (null where y does
    not vary), RMSE. Three points at different x are needed; trim leaves out a part of each key's x range at both ends."""
    if trim:
        w = Window.partitionBy(*keys)
        lo, hi = F.min(x).over(w), F.max(x).over(w)
        points = points.withColumns({"_lo": lo, "_hi": hi}).filter((F.col(x) >= F.col("_lo") + trim * (F.col("_hi") - F.col("_lo"))) & (F.col(x) <= F.col("_hi") - trim * (F.col("_hi") - F.col("_lo"))))
    good = points.filter(finite(F.col(x)) & finite(F.col(y)))
    s = good.groupingSets([[F.col(k) for k in keys], []], *keys).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.when(F.var_pop(y) > 0, F.regr_r2(y, x)).alias("r2"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), (F.max(x) - F.min(x)).alias("range")
    )
    ok = (F.col("n") >= 3) & (F.col("range") > 0)
    rmse = F.sqrt(F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)) / F.col("n"))
    return s.filter(ok).select(*keys, (F.col("gid") > 0).alias("pooled"), "n", "slope", "intercept", "r2", rmse.alias("rmse"))
