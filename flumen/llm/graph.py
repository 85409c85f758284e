"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round. Minima come from a pre-aggregated groupBy and a counted join, so that a hub's edges stay spread out."""
    if large:
        e = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = cut(e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
    e = join_counted(e, low, ["u"], "n")
    if large:
        out = e.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = low.filter("m < u").select("u", F.col("m").alias("v"))
        out = e.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node reachable. edges has longs u and v.

    Each round's edges are kept on disk while the next is planned, as only then does Spark know their size: estimates
    multiply with each join and grow beyond all bounds over some rounds. They are written to the checkpoint folder as
    well, so that an executor's loss costs no more than reading them again."""

    def held(e: DataFrame) -> tuple[DataFrame, tuple]:
        e = cut(e).persist(StorageLevel.DISK_ONLY)
        return e, e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e, mark = held(edges.select("u", "v").filter("u <> v").distinct())
    while True:
        before, (e, now) = e, held(_stars(cut(_stars(e, True)), False))
        before.unpersist()
        if now == mark:
            break
        mark = now
    stars = e.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
    found = cut(stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()))
    e.unpersist()
    return found
