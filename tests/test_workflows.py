"""Workflows, products and decompositions that no query shows, against plain Python."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flumen.functions.validity import clamped, quantity
from flumen.operators import compare, multi, pod, regrid, spectra, vortex, wake
from flumen.plans import order, workflows
from flumen.sources import catalog


def snapshots_of(spark, m):
    rows = [(i, j, float(v)) for i, row in enumerate(m) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "snapshot int, dof int, value double")


def low_rank(n, d, k, seed):
    r = np.random.default_rng(seed)
    return r.normal(size=(n, k)) @ np.diag(10.0 / np.arange(1, k + 1)) @ r.normal(size=(k, d))


def test_randomised_modes_are_the_exact_ones(spark):
    """Of a matrix of few modes, by numpy's own decomposition; modes and coefficients give the matrix back."""
    m = low_rank(40, 30, 4, 1)
    x = m - m.mean(0)
    s = np.linalg.svd(x, compute_uv=False)
    spectrum, modes, a = pod.decompose_randomised(snapshots_of(spark, m), 4, 4)
    got = [r.energy for r in spectrum.orderBy("mode").collect()]
    assert got == pytest.approx((s[:4] ** 2 / 40 / 2).tolist(), rel=1e-8)
    back = np.zeros_like(x)
    for r in pod.reconstruct(modes, a).collect():
        back[r.snapshot, r.dof] = r.x
    assert np.allclose(back, x, atol=1e-8)
    exact = {(r.mode, r.dof): r.phi for r in pod.decompose(snapshots_of(spark, m), 4)[1].collect()}
    assert all(abs(exact[r.mode, r.dof] - r.phi) < 1e-6 for r in modes.collect())


@pytest.mark.parametrize("by", ["dof", "snapshot"])
def test_products_by_partition(spark, by, monkeypatch):
    monkeypatch.setattr(pod, "CHUNK", 3)
    m = low_rank(17, 9, 9, 2)
    x = pod.fluctuations(snapshots_of(spark, m))
    g = m - m.mean(0)
    g = g.T @ g if by == "dof" else g @ g.T
    got = {(r.i, r.j): r.g for r in pod.gram(x, by, "snapshot" if by == "dof" else "dof").collect()}
    assert len(got) == len(g) * (len(g) + 1) // 2 and all(abs(g[k] - v) < 1e-9 for k, v in got.items())


def test_too_many_rows_are_refused_before_they_are_collected(spark, monkeypatch):
    monkeypatch.setattr(pod, "MOST", 5)
    with pytest.raises(ValueError, match="more than the 5 rows"):
        pod.decompose(snapshots_of(spark, low_rank(17, 9, 2, 3)))


def test_ranks_and_sums_over_many_partitions(spark):
    values = [3.0, 1.0, 3.0, 2.0, 5.0, 5.0, 5.0]
    t = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values * 20)], "k int, v double").repartition(7)
    got = {(r.k, r.v): r.rank for r in vortex.ranked(t, ["k"], "v", "rank").collect()}
    for k in (0, 1):
        own = sorted(v for i, v in enumerate(values * 20) if i % 2 == k)
        assert all(got[k, v] == np.mean([i + 1 for i, x in enumerate(own) if x == v]) for v in set(own))
    with pytest.raises(ValueError):
        order.few(spark.range(11), 10)


def test_brackets_by_bucket(spark):
    """Targets on, between, before and beyond uneven coordinates; a single coordinate; far more targets than knots."""
    knots = [0.0, 0.001, 0.5, 7.0, 7.5, 100.0]
    axis = spark.createDataFrame([("a", i, c) for i, c in enumerate(knots)] + [("b", 0, 2.0)], "volume string, idx int, coord double")
    r = np.random.default_rng(1)
    at = sorted({*knots, -1.0, 101.0, *np.round(r.uniform(0, 100, 300), 3).tolist()})
    targets = spark.createDataFrame([("a", x) for x in at] + [("b", 2.0), ("b", 2.1)], "volume string, x double")
    got = {(r.volume, r.x): (r.lo, r.hi, r.weight) for r in regrid.bracket(targets, axis, ["volume"], "x").collect()}
    assert got.pop(("b", 2.0)) == (0, 0, 0.0)
    want = {}
    for x in at:
        if x in knots:
            want["a", x] = (knots.index(x),) * 2 + (0.0,)
        elif 0 < x < 100:
            hi = next(i for i, c in enumerate(knots) if c > x)
            want["a", x] = (hi - 1, hi, pytest.approx((x - knots[hi - 1]) / (knots[hi] - knots[hi - 1])))
    assert got == want


def test_periodogram_against_numpy(spark):
    r = np.random.default_rng(4)
    records = {0: r.normal(size=16), 1: r.normal(size=17), 2: np.array([3.0])}
    t = spark.createDataFrame([(k, i, float(v)) for k, x in records.items() for i, v in enumerate(x)], "record int, i int, x double")
    for kind in ("boxcar", "hann"):
        got = spectra.periodogram(t.filter("record < 2" if kind == "hann" else "true"), ["record"], "i", "x", 2.0, kind).collect()
        for record, x in records.items():
            n = len(x)
            w = np.ones(n) if kind == "boxcar" else 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
            p = np.abs(np.fft.rfft((x - x.mean()) * w)) ** 2 / (2.0 * (w**2).sum()) if w.any() else []
            p[1 : -1 if n % 2 == 0 else None] *= 2
            own = sorted((q for q in got if q.record == record), key=lambda q: q.k)
            assert [q.psd for q in own] == pytest.approx(list(p)) and [q.frequency for q in own] == pytest.approx([2.0 * i / n for i in range(len(p))])
            if kind == "hann" and record == 1:
                break


def test_joint_grid_refuses_too_many_points(spark):
    axes = spark.createDataFrame([("a", ax, i, float(i)) for ax in "xyz" for i in range(5)], "volume string, axis string, idx int, coord double")
    assert multi.uniform_targets(axes).count() == 125 and multi.uniform_targets(axes, 2.0).count() == 27
    with pytest.raises(ValueError):
        multi.uniform_targets(axes, most=124)


def test_band_tables_have_to_be_right(spark, tmp_path):
    good = [("a", 1.0, 0.1, 0.2, 5.0, 0.5, 10.0), ("b", 1.0, 0.1, 0.2, 2.0, 0.2, 10.0)]
    spark.createDataFrame(good, catalog.BANDS).write.option("header", True).csv(str(tmp_path / "good"))
    assert catalog.band_tables(spark, str(tmp_path / "good")).count() == 2
    bad = [*good, ("c", 1.0, 0.1, 0.2, 5.0, 0.4, 10.0), ("d", 1.0, 0.1, 0.3, 5.0, 0.5, 10.0), ("e", 1.0, 0.1, 0.2, 15.0, 1.5, 10.0), ("a", 1.0, 0.1, 0.2, 5.0, 0.5, 10.0)]
    reasons = {r.case: r.reason for r in compare.broken_bands(spark.createDataFrame(bad, catalog.BANDS), ["case", "distance"]).collect()}
    assert reasons == {"a": "repeated", "c": "energy is not fraction x total", "d": "another band", "e": "out of range"}
    spark.createDataFrame(bad, catalog.BANDS).write.option("header", True).csv(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="can't be right"):
        catalog.band_tables(spark, str(tmp_path / "bad"))
    missing = compare.without_baseline(spark.createDataFrame(good, catalog.BANDS), "case", ["distance"], ("a", "Static")).collect()
    assert [(r.distance, r.baseline) for r in missing] == [(1.0, "Static")]


def test_masks_have_to_fit(spark, tmp_path):
    source, path = str(tmp_path / "source"), str(tmp_path / "mask")
    spark.range(3).write.parquet(source)
    mask = spark.createDataFrame([(0, 0, 1), (0, 1, 1)], "iz int, iy int, ix int")
    catalog.write_mask(mask, path, {"min_fraction": 0.9}, source)
    assert catalog.read_mask(spark, path, {"min_fraction": 0.9}, source).count() == 2
    with pytest.raises(ValueError, match="min_fraction"):
        catalog.read_mask(spark, path, {"min_fraction": 0.8}, source)
    spark.range(9).write.mode("append").parquet(source)
    with pytest.raises(ValueError, match="source_size"):
        catalog.read_mask(spark, path, {"min_fraction": 0.9}, source)
    catalog.write_mask(mask.limit(0), str(tmp_path / "none"), {}, source)
    with pytest.raises(ValueError, match="empty"):
        catalog.read_mask(spark, str(tmp_path / "none"), {}, source)


def test_batches_go_on_after_failures(spark, tmp_path):
    found = spark.createDataFrame([(f"in{i}",) for i in range(4)], "path string")
    work = lambda p: spark.range(1) if p != "in1" else (_ for _ in ()).throw(RuntimeError("broken"))
    out = lambda p: str(tmp_path / f"out-{p}")
    run = lambda **k: [r[:2] for r in workflows.batch(found, work, out, str(tmp_path / "manifest"), catalog.Settings(), **k)]
    assert run(limit=1, dry_run=True) == [("in0", "dry-run")]
    assert run(limit=3) == [("in0", "processed"), ("in1", "failed"), ("in2", "processed")]
    assert run() == [("in0", "exists"), ("in1", "failed"), ("in2", "exists"), ("in3", "processed")]
    manifest = spark.read.parquet(str(tmp_path / "manifest"))
    assert manifest.count() == 8 and manifest.filter("status = 'failed'").first().reason == "RuntimeError: broken"


def test_small_things(spark):
    t = spark.createDataFrame([(5, 9, 7), (5, -9, 7), (5, 1, 7)], "a int, b int, c int")
    assert [r[0] for r in t.select(clamped(F.col("a"), F.col("b"), F.col("c"))).collect()] == [7, 0, 6]
    with pytest.raises(ValueError):
        quantity("p")
    rows = spark.createDataFrame([("k", 1.0, 0.1), ("k", 0.005, 0.2)], "k string, amplitude double, phase double")
    assert [r.phase for r in wake.visible_phase(rows, ["k"], "amplitude", "phase").orderBy("amplitude").collect()] == [None, 0.1]
    x = spark.createDataFrame([("b", 3.0), ("a", 9.0), ("b", 5.0)], "volume string, x double")
    assert [r.volume for r in catalog.in_order_of_x(x).orderBy("place").collect()] == ["b", "a"]
