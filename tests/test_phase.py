from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flumen.operators import energy, fill, phase, regrid
from flumen.sources.fields import axes_of

NAN = float("nan")


def test_phase_average_and_harmonic(spark, samples):
    p = np.tile(np.array([1, 3, 5, 7]) * math.pi / 4, 2)
    shape = lambda x: x.reshape(-1, 1, 1, 1)
    s = samples(shape(10 + 2 * np.cos(p) - 3 * np.sin(p)), shape(20 + np.cos(p)), shape(30 - np.sin(p)))
    signal = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "ti int, phase double")
    avg = phase.phase_average(phase.with_phase(s, 4, signal=signal), u_inf=4.0)
    rows = avg.filter("component = 'u'").orderBy("phase_bin").collect()
    assert [r.phase_count for r in rows] == [2] * 4 and rows[0].mean == pytest.approx(10)
    assert all(r.phase_deficit == pytest.approx((4 - r.phase_mean) / 4) and r.coherent_deficit == pytest.approx(-r.coherent / 4) for r in rows)
    h = phase.first_harmonic(avg, 4).filter("component = 'u'").first()
    assert (h.offset, h.a, h.b) == pytest.approx((10, 2, -3)) and h.amplitude == pytest.approx(math.sqrt(13))
    cut = avg.withColumn("phase_mean", F.when(F.col("phase_bin") != 2, F.col("phase_mean")))
    h = phase.first_harmonic(cut, 4).filter("component = 'u'").first()
    assert (h.offset, h.a, h.b, h.n) == pytest.approx((10, 2, -3, 3))
    two = avg.filter("phase_bin < 2")
    assert phase.first_harmonic(two, 4).filter("component = 'u'").first().a is None


def test_sparse_bins(samples):
    s = samples(np.array([1.0, 0, 3, 4]).reshape(-1, 1, 1, 1), t=[0, 0.25, 0.5, 0.75])
    avg = phase.phase_average(phase.with_phase(s, 4, 1.0), "zero", min_fraction=1.0).filter("component = 'u'").orderBy("phase_bin").collect()
    assert [(r.phase_mean, r.phase_count) for r in avg] == [(1, 1), (None, 0), (3, 1), (4, 1)]
    shown = phase.coverage(phase.with_phase(s, 5, 1.0), 5, 0, 0, 0).orderBy("phase_bin").collect()
    assert len(shown) == 5 and [r.accepted for r in shown].count(False) == 1


def test_unwrap(spark):
    t = np.linspace(0, 3, 61)
    df = spark.createDataFrame([("a", float(x), float((2 * math.pi * x) % (2 * math.pi))) for x in t], "k string, t double, phase double")
    out = phase.unwrapped(df, ["k"]).orderBy("t").collect()
    assert np.allclose([r.unwrapped for r in out], 2 * math.pi * t, atol=1e-6)


def _forced(noise=0.0, missing=0.0):
    rng = np.random.default_rng(6)
    t = (np.arange(256) + 0.5) / 64
    cycle = np.floor(2 * t).astype(int)
    u = 3 + np.cos(4 * math.pi * t) + 0.4 * (-1.0) ** cycle + noise * rng.normal(size=256)
    u[rng.random(256) < missing] = NAN
    return t, u, cycle


def test_energy_budget_closed_form(spark, samples):
    t, u, _ = _forced()
    s = samples(u.reshape(-1, 1, 1, 1), t=t)
    r = energy.budget(phase.with_phase(s, 32, 2.0), ["volume"], "u", 32, 2.0).first()
    assert (r.total, r.forcing, r.uniform, r.locked, r.residual) == pytest.approx((0.33, 0.25, 0.25, 0.25, 0.08), abs=2e-3)
    assert r.cv_phase == pytest.approx(0.08 * (8 / 7) ** 2, abs=1e-9)


def test_cross_validation_matches_brute_force(samples):
    t, u, cycle = _forced(0.2, 0.07)
    b = np.minimum(np.floor((4 * math.pi * t) % (2 * math.pi) / (2 * math.pi / 8)), 7).astype(int)
    ok = np.isfinite(u)
    sse = sse_mean = 0.0
    for c in np.unique(cycle):
        test, train = ok & (cycle == c), ok & (cycle != c)
        for k in range(8):
            sse += ((u[test & (b == k)] - u[train & (b == k)].mean()) ** 2).sum()
        sse_mean += ((u[test] - u[train].mean()) ** 2).sum()
    r = energy.budget(phase.with_phase(samples(u.reshape(-1, 1, 1, 1), t=t), 8, 2.0), ["volume"], "u", 8, 2.0).first()
    assert r.cv_phase == pytest.approx(sse / ok.sum() / 2) and r.cv_mean == pytest.approx(sse_mean / ok.sum() / 2)


def _holes(s):
    return s.withColumn("u", F.when(F.col("u") != 0, F.col("u")))


def test_fill_keeps_data(samples):
    s = _holes(samples(np.array([[1, 2, 3], [2, 0, 4], [3, 4, 5]]).reshape(3, 1, 1, 3)))
    out = fill.fill(s, ("t", "x"), ("u",)).orderBy("ti", "ix").collect()
    assert [r.u for r in out] == [1, 2, 3, 2, 3, 4, 3, 4, 5] and sum(r.u_filled for r in out) == 1


@pytest.mark.parametrize("gap, centre", [(2, None), (4, 3.0)])
def test_spatial_gap_is_a_span(samples, gap, centre):
    s = _holes(samples(np.array([1, 0, 0, 0, 5]).reshape(1, 1, 1, 5)))
    assert fill.fill(s, ("x",), ("u",), spatial_gap=gap).filter("ix = 2").first().u == centre


@pytest.mark.parametrize("gap, middle", [(2, None), (3, 4.0)])
def test_temporal_gap_is_for_each_side(samples, gap, middle):
    s = _holes(samples(np.array([1, 0, 0, 0, 0, 0, 7]).reshape(7, 1, 1, 1)))
    out = fill.fill(s, ("t",), ("u",), temporal_gap=gap).orderBy("ti").collect()
    assert out[3].u == middle and out[1].u is None


def test_passes_stop_when_nothing_is_left(samples):
    u = np.ones((3, 5, 5, 5))
    u[-1] = 3
    for z, y, x in ((1, 1, 1), (1, 3, 3), (3, 1, 3), (3, 3, 1)):
        u[1, z, y, x] = 0
    out = fill.fill(_holes(samples(u)), ("t", "x"), ("u",), 2, 5, 5)
    assert out.filter("u_filled").count() == 4 and out.filter("u_filled").agg(F.max("u")).first()[0] == 2


def test_align_is_linear_and_strict(spark, samples):
    z = np.array([-0.5, 0.5, 1.5])
    u = np.add.outer(np.arange(8), z).reshape(8, 3, 1, 1) * np.ones((1, 1, 2, 2))
    s = samples(u).withColumn("z", F.element_at(F.array(*map(F.lit, z.tolist())), F.col("iz") + 1))
    s = s.withColumn("u", F.when(~((F.col("ti") == 3) & (F.col("iz") == 2) & (F.col("iy") == 0) & (F.col("ix") == 0)), F.col("u")))
    targets = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 1.0)], "volume string, idx int, z double")
    out = regrid.align_axis(s, "z", "z", targets)
    assert out.filter("ti = 5 and iz = 1 and iy = 1 and ix = 1").first().u == pytest.approx(6)
    bad = out.filter("u is null").collect()
    assert [(r.ti, r.iz, r.v, r.w) for r in bad] == [(3, 1, None, None)]


def test_trilinear_rejects_outside_and_missing(spark, samples):
    z, y, x = np.meshgrid(range(2), range(2), range(2), indexing="ij")
    field = samples((2 * z + 3 * y + x)[None]).select("volume", "iz", "iy", "ix", "u")
    pts = [(i, *p) for i, p in enumerate((a, b, c) for a in (-0.5, 0.5, 1.5) for b in (-0.5, 0.5, 1.5) for c in (-0.5, 0.5, 1.5))]
    targets = spark.createDataFrame([("a", *p) for p in pts], "volume string, target int, z double, y double, x double")
    axes = axes_of(field, z="iz", y="iy", x="ix")
    out = regrid.trilinear(field, axes, targets, ["u"]).collect()
    assert [(r.target, r.u) for r in out] == [(13, 3.0)]
    assert regrid.trilinear(field.filter("not (iz = 1 and iy = 1 and ix = 1)"), axes, targets, ["u"]).count() == 0


def test_bilinear_bridges_holes(spark):
    p = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (0, 2, 3.0), (1, 0, 5.0)], "iy int, ix int, v double")
    out = regrid.bilinear_rows(p, ["iy"], "ix", spark.createDataFrame([(1.0,), (5.0,)], "ix double"), "v").collect()
    assert [(r.iy, r.ix, r.v) for r in out] == [(0, 1.0, 2.0)]


@pytest.mark.parametrize("kind, expected", [("half", [0.5, 1.5, 1.0]), ("full", [1.0, 1.5, 2.0]), ("gradient", [1.0, 1.5, 2.0])])
def test_cell_widths(spark, kind, expected):
    axes = spark.createDataFrame([("a", "x", i, c) for i, c in enumerate([0.0, 1.0, 3.0])], "volume string, axis string, idx int, coord double")
    assert [r.width for r in regrid.centre_widths(axes, kind).orderBy("idx").collect()] == expected
