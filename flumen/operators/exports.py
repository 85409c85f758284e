"""Two exports of one swirl field, a fine and a coarse one: grids, metrics, components, matches, and a verdict with its
reasons on whether the coarse one will do for finding vortices."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.quantile import with_quantiles
from . import regrid, vortex
from .stats import axis_spacing

KEYS, AXES = ["volume"], ("x", "y", "z")
#: Fixed values of the verdict: limits above or below which a measure counts, and for how much.
SPACING, ERROR, CORRELATION, PERCENTILE, DISPLACEMENT, CORE = ((0.08, 2), (0.04, 1)), ((0.35, 2), (0.2, 1)), ((0.75, 2), (0.9, 1)), 0.35, 0.05, ((4.0, 2), (6.0, 1))
TOO_COARSE, QUALITATIVE = 5, 2


def verdict(measures: DataFrame, diameter: float) -> DataFrame:
    """measures (a row for each key): spacing (largest step of the coarse grid by diameter), nrms, pearson, p99_relative,
    displacement (median of the matches), core (median cells across the coarse components). Adds score, verdict and
    reasons; a measure that is null says nothing."""
    grade = lambda c, limits, over: F.coalesce(reduce(lambda w, x: w.when(F.col(c) > x[0] if over else F.col(c) < x[0], x[1]), limits[1:], F.when(F.col(c) > limits[0][0] if over else F.col(c) < limits[0][0], limits[0][1])), F.lit(0))
    scores = {
        "grid spacing": grade("spacing", SPACING, True), "normalised RMS error": grade("nrms", ERROR, True), "correlation": grade("pearson", CORRELATION, False),
        "99th percentile": F.coalesce((F.abs("p99_relative") > PERCENTILE).cast("int"), F.lit(0)), "displacement of centres": F.coalesce((F.col("displacement") > DISPLACEMENT * diameter).cast("int"), F.lit(0)), "cells across a core": grade("core", CORE, False),
    }
    score = reduce(lambda a, b: a + b, scores.values())
    reasons = F.array_compact(F.array(*(F.when(s > 0, n) for n, s in scores.items())))
    judged = F.when(F.col("score") >= TOO_COARSE, "too coarse").when(F.col("score") >= QUALITATIVE, "qualitative").otherwise("quantitative")
    return measures.withColumn("score", score).withColumns({"verdict": judged, "reasons": reasons})


def _axes(points: DataFrame) -> DataFrame:
    each = [points.select("volume", F.lit(a).alias("axis"), F.col(f"i{a}").alias("idx"), F.col(a).cast("double").alias("coord")).distinct() for a in AXES]
    return cut(reduce(DataFrame.unionByName, each))


def _spacing(axes: DataFrame) -> DataFrame:
    """volume, typical (mean of the axes' median steps), volume of a cell and largest step."""
    step = F.when(F.col("step_median") > 0, F.col("step_median"))
    return axis_spacing(axes).groupBy("volume").agg(F.avg(step).alias("typical"), F.exp(F.sum(F.ln(step))).alias("cell_volume"), F.max("step_median").alias("largest"))


def components(field: DataFrame, spacing: DataFrame, min_size: int = 1, remove_boundary: bool = False) -> DataFrame:
    """Components of a field (volume, ix, iy, iz, x, y, z, s) at each of its thresholds (kind), in coordinates, with core
    diameter and cells across the core."""
    levels = vortex.thresholds(field, KEYS, "s")
    active = field.join(levels, KEYS).filter(F.col("s") >= F.col("level"))
    keys = [*KEYS, "kind"]
    grid = field.groupBy(*KEYS).agg(*(f(a).alias(f"{a}_{n}") for a in AXES for f, n in ((F.min, "first"), (F.max, "last")))).join(levels.select(*keys), KEYS)
    found = vortex.component_stats(vortex.label(active, keys), keys, "s", AXES, min_size=min_size, grid=grid, remove_boundary=remove_boundary)
    found = found.join(spacing, KEYS)
    core = F.pow(6 * F.col("size") * F.col("cell_volume") / math.pi, 1 / 3)
    return found.withColumns({"integral": F.col("integral") * F.col("cell_volume"), "diameter": core, "cells_across": core / F.col("typical")})


def compare_exports(fine: DataFrame, coarse: DataFrame, diameter: float, u_inf: float, min_size: int = 1, remove_boundary: bool = False) -> dict[str, DataFrame]:
    """fine and coarse: volume, x, y, z, swirl (squared swirling strength), each a whole grid. Tables by volume: grids,
    metrics (over the coarse points inside the fine grid), components, matches (with ratios b over a) and verdict. A grid
    with holes or repeated points is an error."""
    sides = {"fine": fine, "coarse": coarse}
    grids, fields, spacings, parts = {}, {}, {}, {}
    for side, points in sides.items():
        points = cut(points.select("volume", *AXES, vortex.nondimensional(F.col("swirl"), diameter, u_inf).alias("s")))
        grids[side] = vortex.inspect_grid(points, KEYS, "s").withColumn("side", F.lit(side))
        if not grids[side].filter("not structured").isEmpty():
            raise ValueError(f"the {side} export is no complete structured grid")
        fields[side] = cut(vortex.grid_indices(points, KEYS))
        axes = _axes(fields[side])
        spacings[side] = cut(_spacing(axes))
        parts[side] = cut(components(fields[side], spacings[side], min_size, remove_boundary))
        sides[side] = axes
    target = F.struct("iz", "iy", "ix")
    at = fields["coarse"].select("volume", target.alias("target"), *(F.col(a).cast("double").alias(a) for a in AXES))
    brought = regrid.trilinear_strict(fields["fine"], sides["fine"], at, ["s"]).withColumnRenamed("s", "fine")
    pairs = brought.join(fields["coarse"].select("volume", target.alias("target"), F.col("s").alias("coarse")), ["volume", "target"])
    metrics = cut(vortex.compare(cut(pairs), KEYS, "coarse", "fine"))
    keys = [*KEYS, "kind"]
    matched = vortex.match_greedily(parts["fine"], parts["coarse"], keys, AXES)
    for side, name in (("fine", "a"), ("coarse", "b")):
        own = parts[side].select(*keys, F.col("component").alias(f"{name}_component"), F.col("size").alias(f"{name}_size"), F.col("peak").alias(f"{name}_peak"), F.col("integral").alias(f"{name}_integral"), F.col("cells_across").alias(f"{name}_core"))
        matched = matched.join(own, [*keys, f"{name}_component"])
    ratios = {f"{c}_ratio": F.try_divide(F.col(f"b_{c}"), F.col(f"a_{c}")) for c in ("size", "peak", "integral")}
    matched = cut(matched.withColumns(ratios))
    measures = spacings["coarse"].select("volume", (F.col("largest") / diameter).alias("spacing")).join(metrics.select("volume", "nrms", "pearson", "p99_relative"), "volume", "left")
    for table, c, name in ((matched, "distance", "displacement"), (parts["coarse"], "cells_across", "core")):
        measures = with_quantiles(measures, table, KEYS, c, [0.5], "_q").withColumn(name, F.get("_q", F.lit(0))).drop("_q")
    return {"grids": grids["fine"].unionByName(grids["coarse"]), "metrics": metrics, "components": parts["fine"].withColumn("side", F.lit("fine")).unionByName(parts["coarse"].withColumn("side", F.lit("coarse"))), "matches": matched, "verdict": verdict(measures, diameter)}
