"""Decompositions of many volumes at once against numpy, with volumes that fail, and runs that go on."""

from __future__ import annotations

import numpy as np

from flumen.plans import batches


def volume(seed, dofs, times, rank):
    r = np.random.default_rng(seed)
    return r.normal(size=(dofs, rank)) @ (np.geomspace(3, 0.5, rank)[:, None] * r.normal(size=(rank, times)))


def table(spark, volumes):
    rows = [(k, int(t), f"d{d}", float(v[d, t])) for k, v in volumes.items() for d, t in np.ndindex(v.shape)]
    return spark.createDataFrame(rows, "volume string, snapshot int, dof string, value double")


def test_volumes_agree_with_numpy_and_fail_alone(spark, monkeypatch):
    monkeypatch.setattr(batches, "VALUES", 150)
    monkeypatch.setattr(batches, "CHUNK", 7)
    good = {"a": volume(1, 40, 9, 3), "b": volume(2, 12, 6, 2), "c": volume(3, 60, 11, 4)}
    bad = {"flat": np.ones((5, 4)), "one": volume(4, 5, 1, 1), "huge": volume(5, 4, 5, 2) * 1e200, "many": volume(6, 3, 13, 2)}
    found = batches.decompose_volumes(table(spark, good | bad), most=12)
    status = {r.volume: r for r in found["status"].collect()}
    assert {k: status[k].status for k in good | bad} == {k: "processed" if k in good else "failed" for k in good | bad}
    assert all(status[k].reason for k in bad) and "two snapshots" in status["one"].reason and "more than 12" in status["many"].reason
    spectra, modes, a = (found[k].toPandas() for k in ("spectra", "modes", "coefficients"))
    assert set(spectra.volume) == set(modes.volume) == set(a.volume) == set(good)
    for k, v in good.items():
        x = v - v.mean(1, keepdims=True)
        s = np.linalg.svd(x, compute_uv=False)
        e = spectra[spectra.volume == k].sort_values("mode")
        n = len(e)
        assert np.allclose(e.energy, s[:n] ** 2 / x.shape[1] / 2) and np.isclose(e.cumulative.iloc[-1], 1)
        phi = modes[modes.volume == k].assign(d=lambda t: t.dof.str[1:].astype(int)).pivot(index="d", columns="mode", values="phi").to_numpy()
        c = a[a.volume == k].pivot(index="mode", columns="snapshot", values="a").to_numpy()
        assert np.allclose(phi @ c, x) and np.allclose(phi.T @ phi, np.eye(n)) and (phi[np.abs(phi).argmax(0), range(n)] > 0).all()


def test_a_run_goes_on_where_it_ended(spark, tmp_path):
    folder, good = str(tmp_path / "pod"), {"a": volume(1, 8, 5, 2), "b": volume(2, 8, 5, 2)}
    assert {r.volume for r in batches.batch_decompose(table(spark, {"a": good["a"], "one": volume(4, 5, 1, 1)}), folder, modes=3).collect()} == {"a", "one"}
    again = batches.batch_decompose(table(spark, good | {"one": volume(4, 5, 1, 1)}), folder, modes=3)
    assert [(r.volume, r.status) for r in again.collect()] == [("b", "processed")]
    assert {r.volume for r in spark.read.parquet(f"{folder}/spectra").collect()} == {"a", "b"}
    assert {(r.volume, r.status) for r in batches.batch_decompose(table(spark, {"one": volume(4, 5, 3, 1)}), folder, retry=True, modes=3).collect()} == {("one", "processed")}
    assert {r.volume for r in batches.batch_decompose(table(spark, good), folder, modes=2).collect()} == {"a", "b"}  # other settings
    n = spark.read.parquet(f"{folder}/spectra").groupBy("volume").count().collect()
    assert {(r.volume, r["count"]) for r in n} == {("a", 2), ("b", 2), ("one", 1)}
