"""Sums along an order and sizes of sides, without one task that holds everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def unused(df: DataFrame, name: str, *others: str) -> str:
    """A column name that is neither df's nor among others."""
    have = {c.lower() for c in (*df.columns, *others)}
    while name in have:
        name += "_"
    return name


def running(df: DataFrame, order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """df in an order, written out, with a column for each total: its sum over all rows before. Spark sorts by ranges;
    sums run within each partition, and the driver adds up one number for each partition and total."""
    part, place = unused(df, "part", *totals), unused(df, "place", *totals)
    df = cut(df.orderBy(*order).withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id()))
    before = Window.partitionBy(part).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(part).agg(*(F.sum(c).alias(name) for name, c in totals.items())).orderBy(part).collect()
    for name, c in totals.items():
        offsets, total = [], 0
        for r in sums:
            offsets += [F.lit(r[part]), F.lit(total)]
            total += r[name] or 0
        offset = F.element_at(F.create_map(*offsets), F.col(part)) if offsets else F.lit(0)
        df = df.withColumn(name, F.coalesce(F.sum(c).over(before), F.lit(0)) + offset)
    return df.drop(part, place)


def few(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df with a broadcast hint, for joins by ranges; it must have few rows."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows where a handful is meant")
    return F.broadcast(df)
