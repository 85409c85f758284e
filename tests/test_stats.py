from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flumen.functions.validity import component_valid, vector_valid
from flumen.operators import stats
from flumen.sources import fields

NAN = float("nan")


def series(*values):
    return np.array(values, float).reshape(-1, 1, 1, 1)


@pytest.mark.parametrize("mode, expected", [("nan", [1, 1, 0, 0]), ("zero", [0, 1, 1, 1]), ("zero-or-nan", [0, 1, 0, 0]), ("none", [1, 1, 1, 1])])
def test_component_validity(spark, mode, expected):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([0.0, 1.0, NAN, math.inf])], "i int, x double")
    assert [r[0] for r in df.orderBy("i").select(component_valid(F.col("x"), mode).cast("int")).collect()] == expected


@pytest.mark.parametrize("mode, expected", [("nan", [1, 1, 1, 0, 0]), ("zero", [0, 1, 1, 1, 1]), ("zero-or-nan", [0, 1, 1, 0, 0])])
def test_vector_validity(spark, mode, expected):
    u, v, w = [0.0, 1.0, 0.0, NAN, NAN], [0.0, 0.0, 2.0, NAN, 2.0], [0.0, 0.0, 0.0, NAN, 3.0]
    df = spark.createDataFrame(list(zip(range(5), u, v, w)), "i int, u double, v double, w double")
    assert [r[0] for r in df.orderBy("i").select(vector_valid([F.col(c) for c in "uvw"], mode).cast("int")).collect()] == expected


def test_unknown_mode():
    with pytest.raises(ValueError):
        component_valid(F.lit(1), "odd")


def test_vector_mask_differs_from_component_mask(samples):
    s = samples(series(0, 2, 4), series(1, 0, 5), series(1, 3, 0))
    r = stats.temporal_mean(s, "zero").first()
    assert (r.u_mean, r.v_mean, r.w_mean, r.u_count) == (3, 3, 2, 2)
    r = stats.temporal_mean(s, "zero", "vector").first()
    assert (r.u_mean, r.v_mean, r.u_count) == (2, 2, 3) and r.w_mean == pytest.approx(4 / 3)


def test_fraction_discards_sparse_means(samples):
    s = samples(series(1, 2, 3, 0, 0), series(1, 2, 3, 4, 0), series(1, 2, 3, 4, 5))
    r = stats.temporal_mean(s, "zero", min_fraction=0.8, u_inf=4.0).first()
    assert (r.u_mean, r.v_mean, r.w_mean, r.u_count, r.speed_from_mean, r.wake_mask_u09) == (None, 2.5, 3, 3, None, False)
    again = stats.cut_by_fraction(stats.temporal_mean(s, "zero", u_inf=4.0), 0.8)
    assert again.first().u_mean is None and "wake_deficit" not in again.columns


def test_zero_or_nan(samples):
    s = samples(series(0, 2, NAN, 4), series(1, 0, NAN, 5), series(1, 3, 0, NAN))
    r = stats.temporal_mean(s, "zero-or-nan").first()
    assert (r.u_mean, r.v_mean, r.w_mean, r.u_count, r.w_count) == (3, 3, 2, 2, 2)


def test_zero_mode_keeps_nan(samples):
    assert math.isnan(stats.temporal_mean(samples(series(1, NAN, 0)), "zero").first().u_mean)


def test_zero_u_inf_is_rejected(samples):
    with pytest.raises(ValueError):
        stats.temporal_mean(samples(series(1)), u_inf=0)


def test_energy_and_stresses_match_numpy(samples):
    rng = np.random.default_rng(1)
    u, v, w = rng.normal(size=(3, 30, 1, 2, 2))
    s = samples(u, v, w)
    mean = stats.temporal_mean(s)
    r = stats.kinetic_energy(s, mean).filter("iy = 1 and ix = 0").first()
    assert r.tke == pytest.approx(0.5 * (u.var(0) + v.var(0) + w.var(0))[0, 1, 0])
    r = stats.reynolds_stresses(s, mean, ("uv",)).filter("iy = 1 and ix = 0").first()
    assert r.uv_stress == pytest.approx(np.cov(u[:, 0, 1, 0], v[:, 0, 1, 0], ddof=0)[0, 1])
    with pytest.raises(ValueError):
        stats.reynolds_stresses(s, mean, ("all", "uv"))


def test_moments_are_stable_for_large_offsets(samples):
    r = stats.moments(samples(series(1e8, 1e8 + 2, 1e8 + 4, 1e8 + 6))).first()
    assert (r.u_mean, r.u_count) == (1e8 + 3, 4) and r.u_rms == pytest.approx(math.sqrt(5))
    r = stats.moments(samples(series(1, 3, 5, 7))).first()
    assert r.u_ti == pytest.approx(25 * math.sqrt(5))
    assert stats.moments(samples(series(1, 3, 5, 7)), u_ref=2.0).first().u_ti == pytest.approx(50 * math.sqrt(5))
    assert stats.moments(samples(series(0, 0, 0, 0))).first().u_ti is None


def test_weighted_withholds_non_finite(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (3.0, NAN, 3.0)], "a double, b double, w double")
    r = stats.weighted(df.withColumn("k", F.lit(1)), ["a", "b"], "w", ["k"]).first()
    assert (r.a, r.b) == (2.5, None)


def test_scans(samples):
    s = samples(np.arange(24).reshape(6, 1, 2, 2))
    assert fields.frame(s, -1, 6).agg(F.min("ti")).first()[0] == 5
    with pytest.raises(IndexError):
        fields.frame(s, 6, 6)
    assert [r.ti for r in fields.frames(s, 1, 6, 2).select("ti").distinct().orderBy("ti").collect()] == [1, 3, 5]
    assert fields.check_samples(s).first().n_missing == 0
    with pytest.raises(KeyError):
        fields.check_samples(s.drop("w"))
    with pytest.raises(ValueError):
        fields.center_slab(s, 2)
    assert fields.center_slab(s, 3, "y").count() == 0
    assert fields.center_slab(s, 1, "y", 0.5).select("iy").distinct().first()[0] == 0


def test_nearest_prefers_the_first(spark):
    axes = spark.createDataFrame([("a", "y", i, float(i)) for i in range(4)], "volume string, axis string, idx int, coord double")
    assert fields.nearest_index(axes, 1.5).first().idx == 1
