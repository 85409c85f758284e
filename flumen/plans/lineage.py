"""Cutting the lineage of iterative plans in the folder that the cluster names."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir, or the one set before. Where none is named, a temporary one
    is made on a single machine (tests); on a cluster that is an error, as executors would not share it."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back: short lineage, safe against lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def held(df: DataFrame) -> DataFrame:
    """As cut, and kept on disk besides, for rounds of joins: only so does Spark know its size, as estimates multiply with
    each join and grow beyond all bounds over some rounds. The caller unpersists it."""
    df = cut(df).persist(StorageLevel.DISK_ONLY)
    df.count()
    return df
