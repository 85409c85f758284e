"""Gap filling along lines of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

AXES = {"t": ("ti", "t"), "z": ("iz", "z"), "y": ("iy", "y"), "x": ("ix", "x")}


def interpolate_line(table: DataFrame, line: list[str], index: str, coord: str, value: str, side_gap: int | None = None, span_gap: int | None = None) -> DataFrame:
    """Null values between two valid ones of a line, linear in the coordinate. side_gap: index distance to each side at
    most; span_gap: between the two sides at most. Nothing is extrapolated. Adds <value>_filled."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(index).alias("i"), F.col(coord).cast("double").alias("c"), F.col(value).alias("v")))
    w = Window.partitionBy(*line).orderBy(index)
    out = table.withColumn("_l", F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_r", F.first(known, True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    inside = F.col(value).isNull() & F.col("_l").isNotNull() & F.col("_r").isNotNull()
    if side_gap is not None:
        inside = inside & (F.col(index) - F.col("_l.i") <= side_gap) & (F.col("_r.i") - F.col(index) <= side_gap)
    if span_gap is not None:
        inside = inside & (F.col("_r.i") - F.col("_l.i") <= span_gap)
    share = F.try_divide(F.col(coord) - F.col("_l.c"), F.col("_r.c") - F.col("_l.c"))
    new = F.when(inside, F.col("_l.v") + share * (F.col("_r.v") - F.col("_l.v")))
    out = out.withColumn("_n", new)
    return out.withColumns({f"{value}_filled": F.col("_n").isNotNull(), value: F.coalesce(value, "_n")}).drop("_l", "_r", "_n")


def fill(samples: DataFrame, axes: tuple[str, ...] = ("t", "x"), values: tuple[str, ...] = ("u", "v", "w"), temporal_gap: int | None = None, spatial_gap: int | None = None, passes: int = 1) -> DataFrame:
    """samples (missing values null) filled along the axes in turn, in several passes; later axes see earlier fills, and
    a pass that fills nothing is the last. Adds <value>_filled. The temporal limit holds for each side, the spatial one
    for the span between both."""
    out = samples.withColumns({f"{v}_was": F.col(v).isNull() for v in values})
    holes = None
    for _ in range(passes):
        for axis in axes:
            index, coord = AXES[axis]
            coord = coord if coord in samples.columns else index
            line = ["volume", *(i for a, (i, _) in AXES.items() if a != axis)]
            for v in values:
                out = interpolate_line(out, line, index, coord, v, temporal_gap if axis == "t" else None, None if axis == "t" else spatial_gap).drop(f"{v}_filled")
        if passes > 1:
            out = cut(out)
            left = out.agg(*(F.count_if(F.col(v).isNull()) for v in values)).first()
            if left == holes:
                break
            holes = left
    return out.withColumns({f"{v}_filled": F.col(f"{v}_was") & F.col(v).isNotNull() for v in values}).drop(*(f"{v}_was" for v in values))

