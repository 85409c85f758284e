from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def samples(spark):
    """samples from arrays of shape (time, z, y, x)."""
    import numpy as np

    def make(u, v=None, w=None, t=None, volume="a"):
        u = np.asarray(u, float)
        v, w = (np.ones_like(u) if x is None else np.asarray(x, float) for x in (v, w))
        t = range(len(u)) if t is None else t
        rows = [(volume, int(i), float(t[i]), int(z), int(y), int(x), *(float(c[i, z, y, x]) for c in (u, v, w))) for i, z, y, x in np.ndindex(u.shape)]
        return spark.createDataFrame(rows, "volume string, ti int, t double, iz int, iy int, ix int, u double, v double, w double")

    return make
