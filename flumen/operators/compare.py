"""Comparisons of cases, grids and volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.validity import is_close
from ..plans.order import few


def grid_differences(a: DataFrame, b: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Coordinates (volume, axis, idx, coord) that one grid lacks or that are not close: empty for compatible grids."""
    key = ["volume", "axis", "idx"]
    both = a.select(*key, F.col("coord").alias("coord_a")).join(b.select(*key, F.col("coord").alias("coord_b")), key, "full")
    return both.filter(~F.coalesce(is_close(F.col("coord_a"), F.col("coord_b"), rtol, atol), F.lit(False)))


def at_cell(raw: DataFrame, filled: DataFrame, mean: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Raw, filled and mean values side by side, and how far apart."""
    out = raw.select(*keys, "ti", F.col(value).alias("raw")).join(filled.select(*keys, "ti", F.col(value).alias("filled")), [*keys, "ti"], "left").join(mean.select(*keys, F.col(f"{value}_mean").alias("mean")), keys, "left")
    return out.withColumns({"filled_less_raw": F.col("filled") - F.col("raw"), "raw_less_mean": F.col("raw") - F.col("mean")})


def to_baselines(rows: DataFrame, group: str, on: list[str], value: str, baselines: tuple[str, ...]) -> DataFrame:
    """Each row against the baseline rows at the same place: ratio, difference, percentage; nothing for a baseline of 0."""
    for name in baselines:
        base = rows.filter(F.col(group) == name).select(*on, F.col(value).alias("_b"))
        rows = rows.join(base, on, "left")
        rows = rows.withColumns({f"{name}_ratio": F.try_divide(F.col(value), F.col("_b")), f"{name}_difference": F.col(value) - F.col("_b"), f"{name}_percent": 100 * F.try_divide(F.col(value) - F.col("_b"), F.col("_b"))}).drop("_b")
    return rows


def without_baseline(rows: DataFrame, group: str, on: list[str], baselines: tuple[str, ...]) -> DataFrame:
    """Places and baselines that rows have no baseline row for; to_baselines gives nothing there, a strict caller stops."""
    places = rows.select(*on).distinct().withColumn("baseline", F.explode(F.array(*map(F.lit, baselines))))
    have = rows.select(*on, F.col(group).alias("baseline")).distinct()
    return places.join(have, [*on, "baseline"], "left_anti")


def broken_bands(rows: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Rows of band tables (keys, low, high, band_energy, fraction, total) that can't be right, with the reason: another
    band than the others', energy that is not fraction x total, values out of range, repeated keys."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    first = rows.agg(F.min("low").alias("_low"), F.min("high").alias("_high"))
    off = F.abs(F.col("band_energy") - F.col("fraction") * F.col("total")) > tolerance * F.greatest(F.abs("total"), F.lit(1.0))
    wrong = ~F.coalesce(F.col("fraction").between(0, 1) & (F.col("total") >= 0) & ~F.isnan("band_energy"), F.lit(False))
    checks = [(F.col("_n") > 1, "repeated"), ((F.col("low") != F.col("_low")) | (F.col("high") != F.col("_high")), "another band"), (wrong, "out of range"), (F.coalesce(off, F.lit(True)), "energy is not fraction x total")]
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, r in checks)))
    return rows.join(n, keys).crossJoin(F.broadcast(first)).select(*keys, F.array_join(reasons, "; ").alias("reason")).filter("reason <> ''")  # one row


def ordered_groups(rows: DataFrame, case: str = "case", distance: str = "distance", x: str = "x_start", label: str = "label") -> DataFrame:
    """rows with place: their order in a report, by distance (unknown last), then start, case and label."""
    from ..plans.order import running

    return running(rows, [F.col(distance).asc_nulls_last(), F.col(x).asc_nulls_last(), F.col(case), F.col(label)], {"place": F.lit(1)})


def missing_combinations(rows: DataFrame, case: str, place: str) -> DataFrame:
    """Pairs of a case and a place that each occur, but not together. Both are short lists of names."""
    pairs = rows.select(case).distinct().crossJoin(few(rows.select(place).distinct(), 1_000_000))
    return pairs.join(rows.select(case, place).distinct(), [case, place], "left_anti")


def unequal_supports(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two supports has."""
    return a.exceptAll(b).withColumn("only_in", F.lit("a")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("b")))


def not_nested(inner: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    return inner.select(*keys).join(outer.select(*keys), keys, "left_anti")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def merged_slabs(rows: DataFrame, place: str, value: str, tolerance: float, trim: float = 0.0) -> DataFrame:
    """One row for each volume and place; places where repeated values differ by more than the tolerance are marked.
    trim leaves out a part of each volume's range at both ends."""
    by = rows.groupBy("volume", place).agg(F.avg(value).alias(value), (F.max(value) - F.min(value) > tolerance).alias("conflict"))
    w = Window.partitionBy("volume")
    by = by.withColumns({"_lo": F.min(place).over(w), "_hi": F.max(place).over(w)})
    span = trim * (F.col("_hi") - F.col("_lo"))
    return by.filter((F.col(place) >= F.col("_lo") + span) & (F.col(place) <= F.col("_hi") - span)).drop("_lo", "_hi")


def coverage_summary(support: DataFrame, keys: list[str], flag: str) -> DataFrame:
    return support.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(flag)).alias("kept"), (100.0 * F.count_if(F.col(flag)) / F.count("*")).alias("percent"))
