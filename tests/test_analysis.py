from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flumen.operators import compare, correlation, multi, pod, probe, spectra, vortex, wake
from flumen.plans import workflows
from flumen.sources import catalog, text

NAN = float("nan")


def test_pair_moments_match_direct_sums(spark):
    rng = np.random.default_rng(823)
    x = rng.normal(size=(11, 8))
    x[rng.random(x.shape) < 0.3] = NAN
    df = spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(x)], "i int, j int, x double").withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = {r.lag: r for r in correlation.pair_moments(df, ["i"], "j", "x", 7, []).collect()}
    for lag in range(8):
        a, b = x[:, : 8 - lag], x[:, lag:]
        ok = np.isfinite(a) & np.isfinite(b)
        assert got[lag].n == ok.sum() and got[lag].ab == pytest.approx((a * b)[ok].sum())


@pytest.mark.parametrize("rho, scale, zero, truncated, status", [([1, 0.5, -0.5], 0.875, 1.5, None, "first_zero_crossing"), ([1, 0.5, 0.25], None, None, 1.125, "no_zero_crossing"), ([1, None, -0.5], None, None, None, "insufficient_pairs_before_zero")])
def test_integral_scale(spark, rho, scale, zero, truncated, status):
    df = spark.createDataFrame([("a", i, None if r is None else float(r)) for i, r in enumerate(rho)], "k string, lag int, rho double")
    r = correlation.integral_scale(df, ["k"]).first()
    assert (r.scale, r.zero, r.truncated, r.status) == (scale, zero, truncated, status)


def _rank_two(spark):
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(24, 3)))
    left = q[:, :2] - q[:, :2].mean(0)
    left, _ = np.linalg.qr(left)
    right, _ = np.linalg.qr(rng.normal(size=(40, 2)))
    x = left @ np.diag([6, 2]) @ right.T
    return x, spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(x)], "snapshot int, dof int, value double").withColumns({"snapshot": F.col("snapshot").cast("long"), "dof": F.col("dof").cast("long")})


@pytest.mark.parametrize("by", ["dof", "snapshot"])
def test_pod_of_rank_two(spark, by):
    x, df = _rank_two(spark)
    spectrum, modes, a = pod.decompose(df, 5, by=by)
    assert [r.fraction for r in spectrum.orderBy("mode").collect()] == pytest.approx([0.9, 0.1])
    back = {(r.snapshot, r.dof): r.x for r in pod.reconstruct(modes, a).collect()}
    assert max(abs(back[i, j] - x[i, j]) for i, j in np.ndindex(x.shape)) < 1e-9
    for r in pod.mode_gram(modes).collect():
        assert r.g == pytest.approx(float(r.i == r.j), abs=1e-9)
    big = modes.groupBy("mode").agg(F.max_by("phi", F.abs("phi")).alias("x")).collect()
    assert all(r.x > 0 for r in big)


def test_periodogram_obeys_parseval_and_finds_peaks(spark):
    for n in (64, 63):
        t = np.arange(n) / 32
        x = 7 + 2 * np.sin(2 * math.pi * 5 * t) + 0.1 * np.cos(2 * math.pi * 9 * t)
        df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k1 string, i int, x double").withColumnRenamed("k1", "name")
        p = spectra.periodogram(df, ["name"], "i", "x", 32.0)
        assert p.agg(F.sum("psd")).first()[0] * 32 / n == pytest.approx(x.var())
    assert spectra.peak(p, ["name"]).first().peak == pytest.approx(5, abs=0.3)
    e = spectra.band_energy(p, ["name"], 4, 6).first()
    assert e.band_fraction > 0.9


def test_welch_segments(spark):
    n = 160
    df = spark.createDataFrame([("a", i, math.sin(i)) for i in range(n)], "name string, i int, x double")
    w = spectra.welch(df, ["name"], "i", "x", 1.0, 40)
    assert w.first().n_segments == 7
    assert spectra.segments(df.limit(39), ["name"], "i", "x", 40, 20).count() == 0


def test_radial_rings_drop_the_last_edge(spark):
    df = spark.createDataFrame([("a", r, 1.0) for r in (0.0, 0.5, 1.0, 2.0)], "k string, r double, v double")
    assert [(x.ring, x.n) for x in wake.radial_average(df, ["k"], "r", "v", 1.0).orderBy("ring").collect()] == [(0, 2), (1, 1)]


def test_sector_area(spark):
    g = np.linspace(-2, 2, 81)
    df = spark.createDataFrame([(float(y), float(z)) for y in g for z in g], "y double, z double")
    area = lambda a: df.agg(F.sum(wake.sector_share(F.col("y"), F.col("z"), F.lit(0.05), F.lit(0.05), 1.0, a, 60.0, 8))).first()[0]
    assert area(-30.0) == pytest.approx(wake.sector_area(1, 60), rel=4e-3) and area(330.0) == pytest.approx(area(-30.0))


def test_straight_line(spark):
    df = spark.createDataFrame([("a", float(i), 2.0 * i + 1) for i in range(5)] + [("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0)], "volume string, x double, y double")
    rows = wake.straight_line(df, ["volume"], "x", "y").collect()
    a = next(r for r in rows if r.volume == "a")
    assert (a.slope, a.intercept, a.rmse) == pytest.approx((2, 1, 0)) and {r.volume for r in rows} == {"a", None}


def test_hole_mask_and_sign(spark):
    df = spark.createDataFrame([(-2.0, 0.0), (-4.0, 1.0)], "s double, u double").withColumn("s", vortex.hole_mask(F.col("s"), [F.col("u")], "velocity-zero"))
    assert sorted(r.s or 0 for r in vortex.signed(df, "s", [], "auto").collect()) == [0, 4]


def test_plane_component(spark):
    values = {(1, 1): 5.0, (1, 0): 1.0, (1, 2): 7.0, (0, 0): 2.0}
    cells = spark.createDataFrame([("a", y, x, v) for (x, y), v in {(1, 1): 7.0, (1, 0): 5.0}.items()], "k string, iy int, ix int, s double")
    r = vortex.component_stats(vortex.label(cells, ["k"], ("iy", "ix")), ["k"], "s", ("iy", "ix")).collect()
    assert len(r) == 1 and (r[0].size, r[0].peak, r[0].ix_centre) == (2, 7, 1) and values


def test_components_of_a_snake(spark):
    """A component far longer than wide, and one apart."""
    path = [(0, x) for x in range(20)] + [(1, 19)] + [(2, x) for x in range(19, -1, -1)]
    cells = spark.createDataFrame([("a", y, x, 1.0) for y, x in path] + [("a", 5, 5, 1.0)], "k string, iy int, ix int, s double")
    sizes = sorted(r["count"] for r in vortex.label(cells, ["k"], ("iy", "ix")).groupBy("root").count().collect())
    assert sizes == [1, 41]


def test_identical_fields_compare_equal(spark):
    df = spark.createDataFrame([("a", float(i), float(i)) for i in range(1, 9)], "k string, x double, y double")
    r = vortex.compare(df, ["k"], "x", "y").first()
    assert (r.rms, r.pearson, r.spearman, r.max_relative) == pytest.approx((0, 1, 1, 0))
    flat = vortex.compare(df.withColumn("x", F.lit(1.0)), ["k"], "x", "y").first()
    assert flat.pearson is None and flat.spearman is None


def test_greedy_matching(spark):
    part = lambda rows: spark.createDataFrame(rows, "k string, component int, integral double, ix_weighted double, iy_weighted double, iz_weighted double")
    a = part([("k", 1, 9.0, 0.0, 0.0, 0.0), ("k", 2, 1.0, 1.0, 0.0, 0.0)])
    b = part([("k", 7, 5.0, 0.9, 0.0, 0.0), ("k", 8, 5.0, 5.0, 0.0, 0.0)])
    assert sorted((r.a_component, r.b_component) for r in vortex.match_greedily(a, b, ["k"]).collect()) == [(1, 7), (2, 8)]


def test_greedy_matching_of_all(spark):
    """No component is left out while one is free, and conflicts are settled by rank."""
    rows = lambda n, shift: [("k", i, float(1000 - i), 10.0 * (i % 203) + shift, 0.0, 0.0) for i in range(n)]
    part = lambda x: spark.createDataFrame(x, "k string, component int, integral double, ix_weighted double, iy_weighted double, iz_weighted double")
    a, b = rows(205, 1.0), rows(203, 0.0)
    free, want = {r[1]: r[3] for r in b}, []
    for _, i, _, x, *_ in a:
        if free:
            j = min(free, key=lambda j: (abs(free[j] - x), j))
            want.append((i, j))
            del free[j]
    assert sorted((r.a_component, r.b_component) for r in vortex.match_greedily(part(a), part(b), ["k"]).collect()) == sorted(want) and len(want) == 203


def test_probe_runs(spark, tmp_path):
    lines = [f"{100 if i != 20 else 103} 100 0 {i} 0 0" for i in range(30)]
    lines[10] = "100 100 0 nan 0 0"
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text("\n".join(lines))
    rows = text.probe_text(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
    lengths = probe.runs(rows, ["file"], "row", "height", "value").groupBy("file", "run").count().orderBy("file", "run").collect()
    assert [r["count"] for r in lengths] == [10, 9, 9, 10, 9, 9]
    assert [(r.kept, r.off_grid, r.not_finite) for r in text.audit(rows).collect()] == [(28, 1, 1)] * 2


def test_profiles_and_baselines(spark):
    df = spark.createDataFrame([("a", v) for v in (-2.0, -4.0, 3.0, NAN)], "k string, v double")
    r = probe.profile(df, ["k"], "v", absolute=False).first()
    assert (r.n, r.mean) == (3, -1) and r.std == pytest.approx(math.sqrt(13))
    rows = spark.createDataFrame([("Flow", 1, 2.0), ("Static", 1, 6.0), ("Moving", 1, 9.0)], "g string, d int, e double")
    out = {r.g: r for r in compare.to_baselines(rows, "g", ["d"], "e", ("Flow", "Static")).collect()}
    assert (out["Static"].Flow_ratio, out["Static"].Flow_difference, out["Static"].Flow_percent, out["Moving"].Static_ratio) == (3, 4, 200, 1.5)


def test_headers_and_aliases(spark, tmp_path):
    assert text.header_of('VARIABLES = "x [m]", "Y", "z"')[0] == ["x [m]", "Y", "z"]
    with pytest.raises(ValueError):
        text.header_of("1 2 3")
    with pytest.raises(KeyError):
        vortex.infer_columns(["x", "y"])
    (tmp_path / "f.csv").write_text("X,y,z,Lambda^2,u\n" + "\n".join(f"{x},{y},{z},{10 + x + 2 * y + 3 * z},{4 + x}" for x in (0, 1) for y in (0, 1) for z in (0, 1)))
    t = text.field_table(spark, str(tmp_path / "f.csv"))
    r = vortex.inspect_grid(t.withColumn("k", F.lit(1)), ["k"], "swirl").first()
    assert r.structured and r.missing == 0 and t.agg(F.max("swirl")).first()[0] == 16


def test_cases(spark, tmp_path):
    reg = {"cases": {"s": {"downstream_distance": "3.5D", "motion_type": "static", "frequency_hz": 2, "u_inf": 4, "files": {"velocity": "v.nc"}}, "m": {"downstream_distance": 2, "motion_type": "surge", "frequency_hz": 1.5}}}
    t = catalog.cases(spark, reg, "/data")
    by = {r.case_id: r for r in t.collect()}
    assert by["s"].distance == 3.5 and by["s"].files["velocity"] == "/data/v.nc"
    assert [(r.case_id, r.reason) for r in catalog.incomplete(t).collect()] == [("m", "no velocity file; no u_inf")]
    f = {r.case_id: (r.frequency, r.source) for r in catalog.forcing_frequency(t).collect()}
    assert f == {"s": (None, "static"), "m": (1.5, "case")}
    with pytest.raises(ValueError):
        catalog.cases(spark, {"x": {}})
    p = str(tmp_path / "out")
    catalog.write_product(t, p, attrs={"a": "b"})
    with pytest.raises(Exception):
        catalog.write_product(t, p)
    assert catalog.available(spark, p) == f"{p}_02"
    assert catalog.resolve(spark, str(tmp_path), "o", "_SUCCESS", "out").endswith("out/_SUCCESS")
    with pytest.raises(ValueError):
        catalog.resolve(spark, str(tmp_path), "o", "_SUCCESS")
    with pytest.raises(FileNotFoundError):
        catalog.resolve(spark, str(tmp_path), "o", "nothing")
    catalog.write_manifest(spark, str(tmp_path / "m"), [("x", "skipped", "no time")], catalog.Settings())
    assert spark.read.parquet(str(tmp_path / "m")).first().settings["mode"] == "nan"


def test_discovery(spark, tmp_path):
    for d in ("surge_2.5D", "surge_3D", "static_2.5D", "x_z0"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "mean.bin").write_text(d)
    found = catalog.discover(spark, str(tmp_path), "*.bin")
    assert sorted((r.case, r.distance) for r in found.collect()) == [("static", 2.5), ("surge", 2.5), ("surge", 3.0)]
    assert [(r["case"], r.distance, r.reason) for r in catalog.incomplete_matrix(found).collect()] == [("static", 3.0, "missing")]
    assert catalog.fingerprints(spark, str(tmp_path / "surge_3D")).first().sha256


def test_surface_and_exceedance(spark):
    f = spark.createDataFrame([("a", 0, 0, x, float(x)) for x in range(4)], "volume string, iz int, iy int, ix int, v double")
    assert [(r.axis, r.ix) for r in multi.surface_points(f, ["volume"], "v", 1.25).collect()] == [("ix", 1.25)]
    assert vortex.exceedance(f, "v", level=2.0).count() == 2 and vortex.exceedance(f, "v", level=9.0).count() == 0


def test_overlap_removal(spark):
    c = spark.createDataFrame([("a", 0, float(x)) for x in range(4)] + [("b", 1, float(x)) for x in range(2, 7)], "volume string, o int, x double")
    assert sorted(r.x for r in wake.outside_earlier(c, "o").filter("volume = 'b'").collect()) == [4, 5, 6]


def test_engine_on_a_known_flow(samples):
    x = np.arange(16) * 20.0
    t = np.arange(24)
    u = 4 + 0.4 * np.cos(2 * math.pi * x[None, None, None] / 120 + 2 * math.pi * t[:, None, None, None] / 8) * np.ones((24, 1, 2, 16))
    out = workflows.Engine(samples(u)).characterise(max_lag=8, spacing=20.0)
    assert out["scales"].filter("component = 'u' and axis = 'x'").first().scale == pytest.approx(120 / (2 * math.pi), rel=0.1)
    assert out["mean"].agg(F.avg("u_mean")).first()[0] == pytest.approx(4)


def test_streaming_mean(spark, samples, tmp_path):
    from flumen.streaming import running

    s = samples(np.arange(12).reshape(6, 1, 1, 2))
    s.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s.schema).parquet(str(tmp_path / "in"))
    q = running.running_mean(stream).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.u_mean for r in spark.table("running").collect()) == [5, 6]


def test_reconstruction_makes_each_value_once(spark):
    modes = spark.createDataFrame([(1, 0, 2.0), (1, 1, 3.0), (2, 1, 5.0), (3, 7, 1.0)], "mode int, dof int, phi double")
    a = spark.createDataFrame([(1, 10, 1.0), (2, 10, 0.5), (2, 11, 2.0)], "mode int, snapshot long, a double")
    back = pod.reconstruct(modes, a)
    assert sorted(map(tuple, back.collect())) == [(10, 0, 2.0), (10, 1, 5.5), (11, 1, 10.0)]
    # No row for each mode besides, and nothing by the mode.
    plan = back._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Aggregate" not in plan and "SortMergeJoin" not in plan and "HashJoin" not in plan
