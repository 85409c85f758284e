"""Planes of products, where products are, cases with their own speed and frequency, and aligned recordings."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flumen.operators import phase, stats
from flumen.plans import cases
from flumen.sources import catalog, fields, products


@pytest.fixture
def field(samples):
    r = np.random.default_rng(5)
    u, v, w = r.normal(size=(3, 8, 2, 3, 4))
    return samples(u, v, w), u, v, w


def test_planes_of_means(field):
    table, u, v, w = field
    mean = stats.temporal_mean(table)
    axes = fields.axes_of(mean, x="ix", y="iy", z="iz").withColumn("coord", F.col("coord") * 10 + 5)
    for axis, index, pick, roles in (("z", -1, np.s_[1], "xyuv"), ("y", 2, np.s_[:, 2], "xzuw"), ("x", 0, np.s_[:, :, 0], "yzvw")):
        rows = products.mean_plane(mean, axis, index, axes).collect()
        of = {c: a.mean(0)[pick] for c, a in zip("uvw", (u, v, w))}
        assert len(rows) == of["u"].size and {(r.horizontal_axis, r.vertical_axis) for r in rows} == {(roles[0], roles[1])}
        for r in rows:
            at = int((r.vertical - 5) / 10), int((r.horizontal - 5) / 10)
            assert (r.vector_horizontal, r.vector_vertical) == pytest.approx((of[roles[2]][at], of[roles[3]][at]))
            assert r.speed == pytest.approx(math.sqrt(sum(of[c][at] ** 2 for c in "uvw"))) and r.u_count == 8 and r.value == r["index"] * 10 + 5
    # Counts of whole vectors stand for those of components, and a stored speed stays.
    old = mean.drop("u_count", "v_count", "w_count").withColumns({"vector_count": F.lit(3), "speed_from_mean": F.lit(7.0)})
    assert {(r.u_count, r.w_count, r.speed) for r in products.mean_plane(old, "z", 0).collect()} == {(3, 3, 7.0)}
    assert {r.u_count for r in products.mean_plane(old.drop("vector_count"), "z", 0).collect()} == {None}
    for wrong, error in ((lambda: products.mean_plane(mean, "z", 2), IndexError), (lambda: products.mean_plane(mean, "z", -3), IndexError), (lambda: products.mean_plane(mean, "t", 0), ValueError), (lambda: products.mean_plane(mean.drop("w_mean"), "z", 0), KeyError)):
        with pytest.raises(error):
            wrong()


def test_an_index_must_be_in_every_volume(samples):
    both = samples(np.ones((1, 2, 2, 2))).unionByName(samples(np.ones((1, 3, 2, 2)), volume="b"))
    mean = stats.temporal_mean(both)
    assert {(r.volume, r["index"]) for r in products.mean_plane(mean, "z", -1).collect()} == {("a", 1), ("b", 2)}
    with pytest.raises(IndexError, match="in a"):
        products.mean_plane(mean, "z", 2)
    assert products.mean_plane(mean.limit(0), "z", 5).count() == 0


def test_planes_of_phases_and_harmonics(field):
    table, u, v, w = field
    averages = phase.phase_average(phase.with_phase(table, 4, 0.25))
    rows = products.phase_plane(averages, 4, -1, "y", 1).collect()
    assert len(rows) == 8
    for r in rows:
        at = np.s_[3::4, int(r.vertical), 1, int(r.horizontal)]
        assert (r.u, r.v, r.vector_vertical, r.w_count, r.bin_frames) == pytest.approx((u[at].mean(), v[at].mean(), w[at].mean(), 2, 2)) and r.phase_degrees == pytest.approx(315)
    coherent = {(r.vertical, r.horizontal): r.u for r in products.phase_plane(averages, 4, 3, "y", 1, "coherent").collect()}
    assert all(coherent[r.vertical, r.horizontal] == pytest.approx(r.u - u[:, int(r.vertical), 1, int(r.horizontal)].mean()) for r in rows)
    series = products.phase_series(averages, 4, 1, 2, 3).orderBy("phase_bin").collect()
    assert [r.w for r in series] == pytest.approx([w[k::4, 1, 2, 3].mean() for k in range(4)])
    harmonics = phase.first_harmonic(averages, 4)
    for quantity in products.QUANTITIES:
        want = {(r.iy, r.ix): r[quantity] for r in harmonics.filter("component = 'w' and iz = 1").collect()}
        got = {(int(r.vertical), int(r.horizontal)): r.data for r in products.harmonic_plane(harmonics, "z", -1, "w", quantity).collect()}
        assert got == pytest.approx(want)
    for wrong, error in ((lambda: products.phase_plane(averages, 4, 4, "y", 1), IndexError), (lambda: products.phase_plane(averages, 4, 0, "y", 1, "mean"), ValueError), (lambda: products.harmonic_plane(harmonics, "z", 0, "u", "n"), ValueError), (lambda: products.harmonic_plane(harmonics.drop("r2"), "z", 0, "u", "r2"), KeyError)):
        with pytest.raises(error):
            wrong()


def test_what_an_inspector_shows(spark):
    plane = spark.createDataFrame([(1.0, 2.0, 9.0, 3, 3, 3), (1.0, 2.0, 9.0, 3, 2, 3), (1.0, 2.0, 9.0, None, 3, 3)], "vector_horizontal double, vector_vertical double, speed double, u_count int, v_count int, w_count int")
    assert [(r.accepted, r.vector_horizontal, r.speed) for r in products.displayed(plane, 3).collect()] == [(True, 1.0, 9.0), (False, 0.0, 9.0), (False, 0.0, 9.0)]
    assert all(r.accepted and r.vector_vertical == 2.0 for r in products.displayed(plane, 1).collect())


def test_coordinates_around_a_center(spark):
    axes = spark.createDataFrame([("a", "x", i, i * 0.5) for i in range(5)] + [("a", "y", 0, 0.0)], "volume string, axis string, idx int, coord double")
    assert sorted(r.idx for r in products.around(axes, "x", 1.0, 0.5).collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="in a; the nearest is 2 at 4"):
        products.around(axes, "x", 9.0, 1.0)


def test_where_products_are(spark, samples, tmp_path):
    root = str(tmp_path)
    mean = stats.temporal_mean(samples(np.ones((2, 1, 1, 1))))
    for folder, label in (("r1", "surge_2D"), ("r2", "surge_5D"), ("r3", "pitch_2D"), ("r4_z0", "surge_7D"), ("wave_3D", None), ("deep/wave_4D", None)):
        catalog.write_product(mean, f"{root}/{folder}/mean", attrs={"label": label} if label else None)
    catalog.write_product(mean.drop("u_mean"), f"{root}/r5/mean")
    (tmp_path / "r6" / "mean").mkdir(parents=True)
    named = lambda df: sorted((r["case"], r["distance"]) for r in df.collect())
    every = [("pitch", 2.0), ("surge", 2.0), ("surge", 5.0), ("wave", 3.0), ("wave", 4.0)]
    assert named(products.mean_products(spark, [root])) == every
    assert named(products.mean_products(spark, [root], exclude=())) == sorted([*every, ("surge", 7.0)])
    assert named(products.mean_products(spark, [f"{root}/r1"])) == [("surge", 2.0)]
    assert named(products.mean_products(spark, [f"{root}/r1/mean", f"{root}/r2/"], siblings=True)) == [("surge", 2.0), ("surge", 5.0)]
    assert named(products.mean_products(spark, [f"{root}/r4_z0", f"{root}/r5", f"{root}/nowhere"])) == []

    catalog.write_product(mean, f"{root}/phases/a_1D/phase_average")
    catalog.write_product(mean, f"{root}/elsewhere/b_2D/phase_average")
    notes = [(f"{root}/elsewhere/b_2D/phase_average", "processed"), (f"{root}/phases/a_1D/phase_average", "processed"), (f"{root}/gone/phase_average", "processed"), (f"{root}/r1/mean", "failed")]
    spark.createDataFrame(notes, "output string, status string").coalesce(1).write.parquet(f"{root}/phases/manifest")
    assert named(products.phase_products(spark, f"{root}/phases")) == [("a", 1.0), ("b", 2.0)]
    assert named(products.phase_products(spark, f"{root}/phases/a_1D/phase_average")) == [("a", 1.0)]


def test_saved_intensities(spark, tmp_path):
    root = str(tmp_path)
    put = lambda place, x, ti: spark.createDataFrame([(float(a), 0.0, 0.0, ti) for a in x], "x double, y double, z double, ti_percent double").coalesce(1).write.parquet(f"{root}/{place}")
    put("LF_b/turbulence_intensity", [5, 6], 1.0)
    put("lf_a/turbulence_intensity/turbulence_intensity", [7, 9], 2.0)
    put("LF_c/turbulence_intensity_saved_mean/turbulence_intensity", [1], 3.0)
    put("LF_c/turbulence_intensity/turbulence_intensity", [1], 4.0)
    put("HF_a/turbulence_intensity", [0], 5.0)
    (tmp_path / "LF_none").mkdir()
    table, without = products.intensity_volumes(spark, root, "lf")
    assert [tuple(r) for r in table.select("place", "volume", "ti_percent").distinct().orderBy("place").collect()] == [(0, "LF_c", 3.0), (1, "LF_b", 1.0), (2, "lf_a", 2.0)]
    assert without == ["LF_none"]
    with pytest.raises(ValueError):
        products.intensity_volumes(spark, root, "wave")
    put("bad_a/turbulence_intensity", [math.nan], 5.0)
    with pytest.raises(ValueError, match="bad_a"):
        products.intensity_volumes(spark, root, "bad")


def test_cases_that_move(spark):
    table = spark.createDataFrame([("a", "x", "STATIC"), ("b", "rig static", "surge"), ("c_Static-2", None, None), ("ecstatic", "statics", "surge")], "case_id string, label string, motion_type string")
    assert [r.case_id for r in products.moving(table).collect()] == ["ecstatic"]
    assert products.moving(table, include_static=True).count() == 4
    assert [r.case_id for r in products.matching(table, "STATIC").orderBy("case_id").collect()] == ["b", "c_Static-2", "ecstatic"]
    assert products.matching(table, None).count() == 4
    with pytest.raises(ValueError, match="only static"):
        products.moving(table.filter("case_id = 'a'"))
    with pytest.raises(ValueError, match="zzz"):
        products.matching(table, "zzz")


def test_frequencies_of_cases(spark):
    rows = [("static", "Static", None, 3.0), ("agrees", "LF", None, 2.0), ("conflict", "LF", None, 3.0), ("stored", "new", None, 4.0), ("known", "HF", "surge", math.nan), ("unknown", "idle", None, -1.0), ("one", "new", None, None), ("two", "new", None, 0.0), ("none", "new", None, None)]
    table = spark.createDataFrame(rows, "case_id string, label string, motion_type string, stored double")
    known = spark.createDataFrame([("LF", 2.0), ("HF", 5.0), ("idle", None)], "label string, frequency double")
    beside = spark.createDataFrame([("one", 6.0), ("one", 6.0), ("one", math.nan), ("two", 1.0), ("two", 2.0), ("none", -1.0)], "case_id string, frequency double")
    got = {r.case_id: (r.frequency, r.source, r.error is None) for r in products.resolved_frequency(table, known, beside).collect()}
    assert got == {
        "static": (None, "static", True), "agrees": (2.0, "stored", True), "conflict": (None, "none", False), "stored": (4.0, "stored", True), "known": (5.0, "known", True),
        "unknown": (None, "known", True), "one": (6.0, "adjacent", True), "two": (None, "none", False), "none": (None, "none", True),
    }
    assert {(r.frequency, r.source, r.error) for r in products.resolved_frequency(table, known, beside, 9.0).collect()} == {(9.0, "explicit", None)}
    with pytest.raises(ValueError):
        products.resolved_frequency(table, explicit=0.0)


def test_runs_over_cases(spark, samples, tmp_path):
    t = np.arange(8)
    wave = lambda f: (3 + np.cos(2 * np.pi * f * t))[:, None, None, None] * np.ones((8, 3, 1, 2))
    both = samples(wave(0.25)).unionByName(samples(wave(0.125), volume="b"))
    table = spark.createDataFrame([("a", 4.0, 0.25, "slow"), ("b", 6.0, 0.125, "fast")], "case_id string, u_inf double, frequency_hz double, label string")
    runs = cases.CaseRuns(both, table, str(tmp_path))
    assert {(r.volume, round(r.u_over_u_inf, 9)) for r in runs.mean().collect()} == {("a", 0.75), ("b", 0.5)}
    # Each case at its own frequency: two frames of a bin are whole periods apart, so the harmonic fits.
    bins = {r.volume: r.n for r in runs.phase_average(4).filter("component = 'u' and iz = 0 and ix = 0").groupBy("volume").agg(F.sum("phase_count").alias("n")).collect()}
    assert bins == {"a": 8, "b": 8}
    own = {r.phase_bin: r.phase_mean for r in runs.phase_average(4).filter("volume = 'b' and component = 'u' and iz = 0 and ix = 0").collect()}
    assert own == pytest.approx({k: wave(0.125)[2 * k : 2 * k + 2, 0, 0, 0].mean() for k in range(4)})
    assert {r.iz for r in runs.slab(1, center=1.0).collect()} == {1} and runs.stresses("uu").count() == runs.kinetic_energy().count() == 12
    path = runs.save("mean", runs.mean())
    assert path == f"{tmp_path}/run/mean" and (tmp_path / "run" / "mean" / "volume=a").is_dir()
    assert {(r.case_id, r.label, r.processing_id) for r in spark.read.parquet(f"{path}.cases").collect()} == {("a", "slow", "run"), ("b", "fast", "run")}
    assert runs.save("energy", runs.kinetic_energy()) == f"{tmp_path}/run/energy"
    assert cases.CaseRuns(both, table, str(tmp_path)).folder() == f"{tmp_path}/run_02"
    with pytest.raises(Exception, match="(?i)exists"):
        runs.save("mean", runs.mean())
    with pytest.raises(ValueError, match="case b has no u_inf"):
        cases.CaseRuns(both, table.withColumn("u_inf", F.when(F.col("case_id") == "a", 4.0))).mean()


def test_an_aligned_recording(spark, samples, tmp_path):
    u = np.arange(2 * 3 * 1 * 2, dtype=float).reshape(2, 3, 1, 2)
    u[1, 1, 0, 0] = np.nan
    u[0, 2, 0, 1] = -99.0
    place = lambda s, z: s.withColumns({"x": F.col("ix") * 1.0, "y": F.col("iy") * 1.0, "z": F.element_at(F.array(*map(F.lit, z)), F.col("iz") + 1)})
    source, reference, output = (str(tmp_path / n) for n in ("source", "reference", "output"))
    place(samples(u), (0.0, 1.0, 2.0)).withColumn("filled", (F.col("iz") == 0) & (F.col("ix") == 1)).write.parquet(source)
    place(samples(np.ones((1, 4, 1, 2)), volume="grid"), (0.25, 1.0, 1.5, 7.0)).write.parquet(reference)
    found = cases.align_product(spark, source, reference, output, fill_values=(-99.0,))

    want = {}
    for ti in range(2):
        for ix in range(2):
            line = [None if math.isnan(a) or a == -99 else a for a in u[ti, :, 0, ix]]
            for k, (lo, hi, wt) in enumerate(((0, 1, 0.25), (1, 1, 0.0), (1, 2, 0.5))):
                ok = line[lo] is not None and line[hi] is not None
                want[ti, k, ix] = ((1 - wt) * line[lo] + wt * line[hi] if ok else None, ok and ix == 1 and lo == 0)
    rows = spark.read.parquet(output).collect()
    assert {(r.ti, r.iz, r.ix): (r.u, r.filled) for r in rows} == {k: (None if v is None else pytest.approx(v), f) for k, (v, f) in want.items()}
    valid = sum(v is not None for v, _ in want.values())
    assert found == {"valid": valid, "missing": 2 * 4 * 2 - valid}
    assert {(r.iz, r.ix): r.fraction for r in spark.read.parquet(f"{output}.fraction").collect()} == {(k, ix): sum(want[ti, k, ix][0] is not None for ti in range(2)) / 2 for k in range(3) for ix in range(2)}
    attrs = {r["name"]: r["value"] for r in spark.read.parquet(f"{output}.attrs").collect()}
    assert attrs["valid_vectors"] == str(valid) and attrs["source"] == source and not catalog.exists(spark, f"{output}.partial")
    with pytest.raises(FileExistsError):
        cases.align_product(spark, source, reference, output)
    spark.read.parquet(reference).withColumn("x", F.col("x") + 0.5).write.parquet(f"{reference}_2")
    with pytest.raises(ValueError, match="along x"):
        cases.align_product(spark, source, f"{reference}_2", f"{output}_2")
