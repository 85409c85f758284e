"""Moments of a stream in several batches equal those of the whole table; late rows are not used."""

from __future__ import annotations

import datetime
import tempfile

import numpy as np
import pytest

from flumen.streaming import running

START = datetime.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    key, old = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, old)


def play(spark, batches, tmp_path, **how):
    """The rows told while files of rows (key, minutes, value) come one by one."""
    folder, told = tmp_path / "in", []
    folder.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame([(k, START + datetime.timedelta(minutes=m), v) for k, m, v in rows], "k string, t timestamp, v double").coalesce(1).write.parquet(str(folder / f"{i}"))
    stream = spark.readStream.schema("k string, t timestamp, v double").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/*")
    out = running.running_moments(stream, "t", ["k"], "v", "10 minutes", **how)
    query = out.writeStream.outputMode("append" if how.get("hold") else "update").foreachBatch(lambda df, i: told.extend((i, r) for r in df.collect())).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start()
    query.awaitTermination(150)
    return [r for _, r in sorted(told, key=lambda x: x[0])]


def test_moments_of_a_split_stream_equal_those_of_the_table(spark, rocks, tmp_path):
    r = np.random.default_rng(0)
    batches = [[(str(r.choice(["a", "b"])), 5 * i + int(r.integers(0, 5)), float(1e6 + r.normal())) for _ in range(40)] + [("a", 5 * i, float("nan")), ("b", 5 * i, None)] for i in range(4)]
    last = {x.k: x for x in play(spark, batches, tmp_path)}
    for k in "ab":
        v = np.array([x for rows in batches for key, _, x in rows if key == k and x is not None and np.isfinite(x)])
        assert last[k].n == len(v) and np.isclose(last[k]["mean"], v.mean(), rtol=1e-13) and np.isclose(last[k].variance, v.var(), rtol=1e-6)


def test_late_rows_change_nothing_and_closed_keys_are_told_once(spark, rocks, tmp_path):
    batches = [[("a", 0, 1.0), ("a", 1, 3.0)], [("b", 60, 5.0)], [("b", 61, 7.0)], [("a", 2, 100.0), ("b", 62, None)], [("c", 500, 1.0)], [("c", 501, 2.0)]]
    told = [(x.k, x.n, x["mean"], x.variance) for x in play(spark, batches, tmp_path, hold=True)]
    assert told == [("a", 2, 2.0, 1.0), ("b", 2, 6.0, 1.0)]
