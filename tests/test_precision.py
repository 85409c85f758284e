"""Coordinates that meet within a tolerance, and recordings of different precision against numpy."""

from __future__ import annotations

import numpy as np
import pytest

from flumen.operators import precision
from flumen.sources import fields


def axis(spark, values, name="x"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(values)], "axis string, idx int, coord double")


def test_coordinates_meet_within_the_tolerance(spark):
    a, b = axis(spark, [0.0, 1.0, 2.0, 3.0, -4.0]), axis(spark, [0.009, 0.995, 2.02, 3.0, 3.004, -4.01])
    pairs, alone = precision.matched_axes(a, b, 1e-2)
    assert sorted((r.idx, r.other) for r in pairs.collect()) == [(0, 0), (1, 1), (3, 3), (4, 5)]
    assert sorted((r.side, r.idx) for r in alone.collect()) == [("a", 2), ("b", 2), ("b", 4)]
    assert precision.matched_axes(a, a.withColumnRenamed("idx", "idx"), 1e-9)[1].count() == 0


def test_a_box_without_coordinates_names_the_nearest(spark):
    pairs, _ = precision.matched_axes(axis(spark, [0.0, 1.0]), axis(spark, [0.0, 1.0]), 1e-3)
    assert precision.within(pairs, {"x": (0.5, 0.5)}).count() == 2
    with pytest.raises(ValueError, match="nearest is 1.0"):
        precision.within(pairs, {"x": (5.0, 0.5)})


def test_recordings_agree_with_numpy(spark, samples):
    r = np.random.default_rng(0)
    u = r.normal(size=(12, 2, 3, 4))
    v = u.astype(np.float16).astype(float)
    u[3, 0, 0, 0], v[5, 1, 1, 1] = np.nan, np.nan
    a, b = samples(u, u * 2, u + 1), samples(v, v * 2, v + 1)
    axes = lambda t, shift: fields.axes_of(t.selectExpr("*", f"iz + {shift} AS z", f"iy + {shift} AS y", f"ix + {shift} AS x"), z="z", y="y", x="x").drop("volume")
    got, alone = precision.compare(a, b, axes(a, 0), axes(b, 0.003))
    by = {(x.component, x.quantity): x for x in got.collect()}
    assert alone.count() == 0 and len(by) == 10
    d = np.abs((u - np.nanmean(u, 0)) - (v - np.nanmean(v, 0)))
    good = d[np.isfinite(d)]
    x = by["u", "fluctuation"]
    assert x.n == len(good) and np.allclose([x["mean"], x.p95, x.p99, x["max"]], [good.mean(), *np.percentile(good, [95, 99]), good.max()])
    assert np.isclose(x.mean_relative, good.mean() / np.sqrt(np.mean((u - np.nanmean(u, 0))[np.isfinite(d)] ** 2)))
    var = np.abs(np.nanvar(u, 0) - np.nanvar(v, 0))
    assert np.isclose(by["u", "variance"]["max"], var.max()) and np.isclose(by["tke", "variance"]["mean"], (6 * var / 2).mean()) and by["u", "count"]["max"] == 1
