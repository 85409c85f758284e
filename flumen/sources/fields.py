"""Field views: any table as samples of a gridded, time-resolved vector field, and scans of them.

samples: volume, ti, t, iz, iy, ix, u, v, w (and filled, where known); one row for each sample. Indices are small
integers, coordinates live in an axes table (volume, axis, idx, coord).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.validity import component_valid, finite, vector_valid

VOXEL = ["volume", "iz", "iy", "ix"]
SAMPLE = ["volume", "ti", "t", "iz", "iy", "ix", "u", "v", "w"]


def as_samples(table: DataFrame, **columns: Column | str) -> DataFrame:
    """A field view of a table; columns says how each of SAMPLE comes from it."""
    missing = [c for c in SAMPLE if c not in columns]
    if missing:
        raise KeyError(f"no source for {missing}")
    return table.select(*(F.expr(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in columns.items()))


def check_samples(samples: DataFrame) -> DataFrame:
    """One row for each volume: samples, frames, grid size, repeated and missing samples. Fails if a column is missing."""
    missing = [c for c in SAMPLE if c not in samples.columns]
    if missing:
        raise KeyError(f"samples lack {missing}")
    each = samples.groupBy("volume", "ti", "iz", "iy", "ix").agg(F.count("*").alias("n"))
    size = each.groupBy("volume").agg(
        F.sum("n").alias("n_samples"), F.count_distinct("ti").alias("n_times"), F.count_distinct("iz").alias("nz"), F.count_distinct("iy").alias("ny"), F.count_distinct("ix").alias("nx"), F.sum(F.col("n") - 1).alias("n_repeated")
    )
    return size.withColumn("n_missing", F.col("n_times") * F.col("nz") * F.col("ny") * F.col("nx") - (F.col("n_samples") - F.col("n_repeated")))


def frame(samples: DataFrame, index: int, n_times: int | None = None) -> DataFrame:
    """One time index; a negative one counts from the end and needs n_times."""
    if index < 0 or n_times is not None:
        if n_times is None or not -n_times <= index < n_times:
            raise IndexError(index)
        index %= n_times
    return samples.filter(F.col("ti") == index)


def frames(samples: DataFrame, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    picked = samples.filter(F.col("ti") >= start)
    picked = picked if stop is None else picked.filter(F.col("ti") < stop)
    return picked if step == 1 else picked.filter((F.col("ti") - start) % step == 0)


def plane(samples: DataFrame, axis: str, index: int) -> DataFrame:
    return samples.filter(F.col(f"i{axis}") == index)


def region(samples: DataFrame, **bounds: tuple[float, float]) -> DataFrame:
    """Samples within inclusive bounds of any columns."""
    for name, (low, high) in bounds.items():
        samples = samples.filter(F.col(name).between(low, high))
    return samples


def selected(samples: DataFrame, scale: float = 1.0, t_scale: float = 1.0, fills: bool = False, **bounds: tuple[float, float]) -> DataFrame:
    """A region in other units, filled samples as missing unless they are asked for."""
    picked = region(samples, **bounds)
    keep = F.lit(True) if fills or "filled" not in samples.columns else ~F.coalesce(F.col("filled"), F.lit(False))
    out = {c: F.when(keep, F.col(c) * scale) for c in ("u", "v", "w")} | {"t": F.col("t") * t_scale}
    return picked.withColumns(out)


def with_validity(samples: DataFrame, mode: str = "nan", fill_values: tuple[float, ...] = (), exclude_filled: bool = False) -> DataFrame:
    """samples with a column valid: all components finite and no fill value, and as the mode asks."""
    ok = vector_valid([F.col(c) for c in ("u", "v", "w")], mode) & finite(F.col("u")) & finite(F.col("v")) & finite(F.col("w"))
    for c in ("u", "v", "w"):
        for x in fill_values:
            ok = ok & (F.col(c) != x)
    if exclude_filled and "filled" in samples.columns:
        ok = ok & ~F.coalesce(F.col("filled"), F.lit(False))
    return samples.withColumn("valid", F.coalesce(ok, F.lit(False)))


def describe(samples: DataFrame, axes: tuple[str, ...] = ("t", "iz", "iy", "ix")) -> DataFrame:
    """volume, axis, n, low, high and spacing (median, least, most) of the different values along each axis."""
    from ..operators.stats import axis_spacing

    values = None
    for a in axes:
        one = samples.select("volume", F.lit(a).alias("axis"), F.col(a).cast("double").alias("coord")).distinct()
        values = one if values is None else values.unionByName(one)
    return axis_spacing(values)


def center_slab(samples: DataFrame, width: int, axis: str = "z", center: float = 0.0, coord: str | None = None) -> DataFrame:
    """Planes around the one nearest to the center; the width is odd and must fit."""
    if width < 1 or width % 2 == 0:
        raise ValueError("the width of a slab is odd")
    index = f"i{axis}"
    at = F.col(coord or index).cast("double")
    known = samples.select("volume", index, at.alias("c")).distinct()
    mid = known.groupBy("volume").agg(F.min_by(index, F.struct(F.abs(F.col("c") - center), F.col(index))).alias("mid"), F.min(index).alias("low"), F.max(index).alias("high"))
    half = width // 2
    fits = mid.filter((F.col("mid") - half >= F.col("low")) & (F.col("mid") + half <= F.col("high")))
    return samples.join(fits.select("volume", "mid"), "volume").filter(F.abs(F.col(index) - F.col("mid")) <= half).drop("mid")


def nearest_index(axes: DataFrame, value: float) -> DataFrame:
    """volume, axis and idx nearest to the value, the first of equally near ones."""
    return axes.groupBy("volume", "axis").agg(F.min_by("idx", F.struct(F.abs(F.col("coord") - value), F.col("idx"))).alias("idx"))


def axes_of(samples: DataFrame, **coords: str) -> DataFrame:
    """volume, axis, idx, coord from an index and a coordinate column for each axis."""
    out = None
    for axis, coord in coords.items():
        one = samples.groupBy("volume", F.col(f"i{axis}").alias("idx")).agg(F.min(F.col(coord).cast("double")).alias("coord")).withColumn("axis", F.lit(axis))
        out = one if out is None else out.unionByName(one)
    return out.select("volume", "axis", "idx", "coord")


def counted(samples: DataFrame, mode: str = "nan") -> DataFrame:
    """Valid and all samples of each component in each volume."""
    return samples.groupBy("volume").agg(F.count("*").alias("n"), *(F.count_if(component_valid(F.col(c), mode)).alias(f"{c}_valid") for c in ("u", "v", "w")), F.count_if(vector_valid([F.col("u"), F.col("v"), F.col("w")], mode)).alias("vector_valid"))


# Views of the general tables, so that every verb can run over them.


def lineitem_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field over order lines: zeros in w, NaN in some u, irregular repeated samples."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    u = F.when(F.col("l_orderkey") % 11 == 3, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return as_samples(
        t, volume=F.col("l_returnflag"), ti=day, t=day.cast("double"), iz=(F.col("l_partkey") % 4).cast("int"), iy=(F.col("l_suppkey") % 5).cast("int"), ix=F.col("l_linenumber").cast("int"),
        u=u, v=F.col("l_extendedprice") / 1000, w=F.col("l_discount"), row=F.col("l_orderkey"), filled=F.col("l_tax") == 0,
    )


def event_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, id, t (seconds) and value over events, some values missing."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.when(F.pmod(F.col("event_id") * 7919, F.lit(10)) >= 3, F.col("value"))
    return t.select(F.col("event_type").alias("series"), "user_id", F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), value.alias("value"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snapshot, dof, value over embeddings."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return t.select(F.col("vec_id").alias("snapshot"), F.posexplode("embedding").alias("dof", "value")).withColumn("value", F.col("value").cast("double"))
