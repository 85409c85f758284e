"""Interpolation between grids, common supports, blends of volumes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.order import few


def bracket(targets: DataFrame, axis: DataFrame, keys: list[str], at: str) -> DataFrame:
    """For each target coordinate, the axis' neighbours: lo, hi (indices) and weight of hi. A target on a coordinate has
    it on both sides; one outside has none and is left out. axis: keys, idx, coord.

    The axis is cut into as many equal buckets as it has coordinates; each of its steps is in the buckets it reaches
    into, and a target meets the steps of its bucket. So targets are neither compared with the whole axis nor all of them
    sorted in one task, and a bucket with very many of them can be split.
    """
    c = F.col("coord").cast("double")
    ahead = F.lead(F.struct(F.col("idx").alias("i"), c.alias("c"))).over(Window.partitionBy(*keys).orderBy(c))
    steps = axis.select(*keys, F.struct(F.col("idx").alias("i"), c.alias("c")).alias("lo"), ahead.alias("next"))
    span = steps.groupBy(*keys).agg(F.min("lo.c").alias("_c0"), F.max("lo.c").alias("_c1"), F.count("*").alias("_n"))
    width = F.when(F.col("_c1") > F.col("_c0"), (F.col("_c1") - F.col("_c0")) / F.col("_n")).otherwise(1.0)
    bucket = lambda x: F.floor((x - F.col("_c0")) / width)
    steps = steps.join(span, keys).withColumn("_b", F.explode(F.sequence(bucket(F.col("lo.c")), bucket(F.coalesce("next.c", "lo.c")))))
    marks = targets.select(*keys, F.col(at).cast("double").alias(at)).distinct().join(span, keys).filter(F.col(at).between(F.col("_c0"), F.col("_c1"))).withColumn("_b", bucket(F.col(at)))
    met = marks.join(steps.select(*keys, "_b", "lo", "next"), [*keys, "_b"])
    on = F.col(at) == F.col("lo.c")
    found = met.filter(on | ((F.col(at) > F.col("lo.c")) & (F.col(at) < F.col("next.c"))))
    weight = F.when(on, 0.0).otherwise((F.col(at) - F.col("lo.c")) / (F.col("next.c") - F.col("lo.c")))
    return found.select(*keys, at, F.col("lo.i").alias("lo"), F.when(on, F.col("lo.i")).otherwise(F.col("next.i")).alias("hi"), weight.alias("weight"))


def align_axis(samples: DataFrame, axis: str, coord: str, targets: DataFrame, values: tuple[str, ...] = ("u", "v", "w"), strict: bool = True) -> DataFrame:
    """samples brought to target planes (volume, idx, <coord>) along one axis. strict: both neighbours must be valid in
    all values; else one of weight zero needn't be."""
    index = f"i{axis}"
    rest = [c for c in ("volume", "ti", "t", "iz", "iy", "ix") if c in samples.columns and c != index]
    known = samples.groupBy("volume", F.col(index).alias("idx")).agg(F.min(F.col(coord).cast("double")).alias("coord"))
    b = bracket(targets, known, ["volume"], coord).join(targets, ["volume", coord])
    ends = b.select("volume", coord, "idx", F.explode(F.array(F.struct(F.col("lo").alias("src"), (1 - F.col("weight")).alias("weight")), F.struct(F.col("hi").alias("src"), F.col("weight").alias("weight")))).alias("e")).select("volume", coord, "idx", "e.*")
    near = samples.select(*rest, F.col(index).alias("src"), *values).join(ends, ["volume", "src"])
    good = reduce(lambda a, c: a & c, (F.col(v).isNotNull() for v in values))
    ok = good if strict else good | (F.col("weight") == 0)
    value = lambda v: F.when(F.bool_and(ok) & (F.count("*") == 2), F.sum(F.when(F.col("weight") != 0, F.col(v) * F.col("weight")).otherwise(0.0)))
    return near.groupBy(*rest, F.col("idx").alias(index), F.col(coord)).agg(*(value(v).alias(v) for v in values))


def interpolation_table(axes: DataFrame, targets: DataFrame, eps: float = 1e-12) -> DataFrame:
    """The sparse map from each volume's voxels to target points (volume, target, z, y, x): volume, target, iz, iy, ix,
    weight, and corners, how many rows a target has. It depends on the axes alone, so one table serves every field of a
    volume. Targets outside have no rows; corners of weight below eps are left out."""
    marks = [targets.select("volume", F.lit(a).alias("axis"), F.col(a).cast("double").alias("at")).distinct() for a in ("z", "y", "x")]
    # Different coordinates only, so it is far smaller than the targets; written out, as it is joined once for each axis.
    found = cut(bracket(reduce(DataFrame.unionByName, marks), axes, ["volume", "axis"], "at"))
    out = targets.withColumns({a: F.col(a).cast("double") for a in ("z", "y", "x")})
    for a in ("z", "y", "x"):
        own = found.filter(F.col("axis") == a).select("volume", F.col("at").alias(a), F.col("lo").alias(f"{a}0"), F.col("hi").alias(f"{a}1"), F.col("weight").alias(f"{a}w"))
        out = out.join(own, ["volume", a])
    pick = lambda a, i: F.struct(F.col(f"{a}{i}").alias("i"), (F.col(f"{a}w") if i else 1 - F.col(f"{a}w")).alias("w"))
    corner = lambda k: [pick(a, k >> s & 1) for a, s in (("z", 2), ("y", 1), ("x", 0))]
    eight = F.array(*(F.struct(z["i"].alias("iz"), y["i"].alias("iy"), x["i"].alias("ix"), (z["w"] * y["w"] * x["w"]).alias("weight")) for z, y, x in map(corner, range(8))))
    used = F.filter(eight, lambda c: c["weight"] >= eps)
    return out.select("volume", "target", F.size(used).alias("corners"), F.explode(used).alias("c")).select("volume", "target", "c.*", "corners")


def apply_table(table: DataFrame, field: DataFrame, values: list[str], keys: list[str] = ()) -> DataFrame:
    """field (volume, iz, iy, ix, keys, values) at the targets of an interpolation table: one join and one aggregate,
    whatever the number of fields (keys tell them apart). A target whose corners aren't all there is left out."""
    valid = reduce(lambda a, c: a & c, (F.col(v).isNotNull() for v in values))
    there = field.filter(valid).select("volume", "iz", "iy", "ix", *keys, *values)
    found = there.join(table, ["volume", "iz", "iy", "ix"]).groupBy("volume", "target", *keys).agg(F.count("*").alias("_n"), F.first("corners").alias("_corners"), *(F.sum(F.col(v) * F.col("weight")).alias(v) for v in values))
    return found.filter("_n = _corners").drop("_n", "_corners")


def trilinear(field: DataFrame, axes: DataFrame, targets: DataFrame, values: list[str], eps: float = 1e-12) -> DataFrame:
    """field (volume, iz, iy, ix, values) at targets (volume, target, z, y, x): weighted corners of the cell that holds
    the target. Targets outside, or with a corner of weight that is missing, are left out."""
    return apply_table(interpolation_table(axes, targets, eps), field, values)


def bilinear_rows(plane: DataFrame, line: list[str], index: str, targets: DataFrame, value: str) -> DataFrame:
    """Linear interpolation along each line between its finite points (missing ones are bridged), at the targets (a
    column named as index); null outside and with fewer than two finite points."""
    known = plane.filter(F.col(value).isNotNull())
    enough = known.groupBy(*line).agg(F.count("*").alias("n")).filter("n >= 2").drop("n")
    marks = enough.crossJoin(few(targets.select(F.col(index).cast("double").alias("at")), 100_000))
    b = bracket(marks, known.select(*line, F.struct(F.col(index).cast("double").alias("c"), F.col(value).alias("v")).alias("idx"), F.col(index).alias("coord")), line, "at")
    return b.select(*line, F.col("at").alias(index), (F.col("lo.v") + F.col("weight") * (F.col("hi.v") - F.col("lo.v"))).alias(value))


def bilinear(plane: DataFrame, keys: list[str], targets_x: DataFrame, targets_y: DataFrame, value: str, x: str = "x", y: str = "y") -> DataFrame:
    """A plane (keys, y, x, value) on a target grid: first along x at each y, then along y at each target x."""
    rows = bilinear_rows(plane, [*keys, y], x, targets_x, value)
    return bilinear_rows(rows, [*keys, x], y, targets_y, value)


def common_support(counts: DataFrame, keys: list[str], case: str, min_fraction: float, least: int = 2) -> DataFrame:
    """Voxels that every case covers with at least the fraction's part of its frames, and `least`; counts: keys, case,
    n (valid frames), n_times. Adds the least availability."""
    n_cases = counts.select(case).distinct().agg(F.count("*").alias("n_cases"))
    ok = (F.col("n") >= F.ceil(min_fraction * F.col("n_times"))) & (F.col("n") >= least)
    by = counts.groupBy(*keys).agg(F.bool_and(ok).alias("ok"), F.count_distinct(case).alias("n"), F.min(F.try_divide(F.col("n"), F.col("n_times"))).alias("availability"))
    return by.crossJoin(F.broadcast(n_cases)).select(*keys, (F.col("ok") & (F.col("n") == F.col("n_cases"))).alias("support"), "availability")


def blend(volumes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Volumes on one grid as one: mean over the volumes that have a value, and how many these are."""
    return volumes.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias(value), F.count_distinct("volume").alias("contributors"))


def overlap_diagnostics(volumes: DataFrame, keys: list[str], re: str, im: str) -> DataFrame:
    """Each pair of volumes on the voxels they share: number, RMS difference, complex correlation and phase difference
    of their harmonics (re, im)."""
    a, b = volumes.alias("a"), volumes.alias("b")
    both = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.volume") < F.col("b.volume")])
    ar, ai, br, bi = (F.col(x) for x in (f"a.{re}", f"a.{im}", f"b.{re}", f"b.{im}"))
    sums = both.groupBy(F.col("a.volume").alias("first"), F.col("b.volume").alias("second")).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(F.pow(ar - br, 2) + F.pow(ai - bi, 2))).alias("rms"), F.sum(ar * br + ai * bi).alias("x"), F.sum(ai * br - ar * bi).alias("y"), F.sum(ar * ar + ai * ai).alias("p"), F.sum(br * br + bi * bi).alias("q")
    )
    return sums.select("first", "second", "n", "rms", F.try_divide(F.hypot("x", "y"), F.sqrt(F.col("p") * F.col("q"))).alias("correlation"), F.degrees(F.atan2("y", "x")).alias("phase_difference"))


def centre_widths(axes: DataFrame, convention: str = "half") -> DataFrame:
    """Width of each coordinate's cell. half: end cells reach to half their only step; full: end cells are as wide as
    that step; gradient: half of what lies between both neighbours, whole steps at the ends. A single coordinate has
    width 1 under full."""
    w = Window.partitionBy("volume", "axis").orderBy("idx")
    before, after = F.col("coord") - F.lag("coord").over(w), F.lead("coord").over(w) - F.col("coord")
    ends = {"half": lambda s: s / 2, "full": lambda s: s, "gradient": lambda s: s}
    if convention not in ends:
        raise ValueError(f"convention is one of {tuple(ends)}")
    inner, end = (before + after) / 2, ends[convention](F.coalesce(before, after))
    width: Column = F.abs(F.coalesce(inner, end))
    return axes.withColumn("width", F.coalesce(width, F.lit(1.0)) if convention == "full" else width)


def trilinear_strict(field: DataFrame, axes: DataFrame, targets: DataFrame, values: list[str]) -> DataFrame:
    """As trilinear, but a corner that is missing spoils the target even at weight zero: its values are null."""
    found = trilinear(field, axes, targets, values, eps=-1.0)
    inside = targets
    for a in ("z", "y", "x"):
        inside = inside.join(bracket(targets, axes.filter(F.col("axis") == a), ["volume"], a).select("volume", a), ["volume", a], "left_semi")
    return inside.select("volume", "target").join(found, ["volume", "target"], "left")


def extents(axes: DataFrame, axis: str) -> DataFrame:
    """The range that all volumes share along an axis, its thirds and centre; nothing where they share none."""
    by = axes.filter(F.col("axis") == axis).groupBy("volume").agg(F.min("coord").alias("lo"), F.max("coord").alias("hi"))
    common = by.agg(F.max("lo").alias("low"), F.min("hi").alias("high")).filter("low <= high")
    at = lambda s: F.col("low") + (F.col("high") - F.col("low")) * s
    return common.select("low", "high", at(1 / 3).alias("third"), at(0.5).alias("centre"), at(2 / 3).alias("two_thirds"))


def valid_counts(samples: DataFrame, axis: str, coord: str, targets: DataFrame, value: str = "u") -> DataFrame:
    """Frames in which a target voxel has a value after alignment along an axis, and the frames there are."""
    aligned = align_axis(samples, axis, coord, targets, (value,))
    times = aligned.select("volume", "ti").distinct().groupBy("volume").agg(F.count("*").alias("n_times"))
    return aligned.groupBy("volume", "iz", "iy", "ix").agg(F.count(value).alias("n")).join(times, "volume")
