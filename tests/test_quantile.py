"""Exact order statistics against numpy."""

from __future__ import annotations

import numpy as np
import pytest

from flumen.plans import quantile
from flumen.plans.quantile import quantiles

AT = [0.0, 0.01, 0.25, 0.5, 0.9, 0.975, 0.99, 1.0]


def values(kind, n, seed=1):
    r = np.random.default_rng(seed)
    return {
        "normal": lambda: r.normal(size=n), "wide": lambda: 10.0 ** r.uniform(-300, 300, n) * r.choice([-1, 1], n), "ties": lambda: r.integers(0, 4, n).astype(float),
        "mostly zero": lambda: np.where(r.random(n) < 0.9, 0.0, r.normal(size=n)), "same": lambda: np.full(n, 7.5), "two ends": lambda: np.where(r.random(n) < 0.5, -1.0, 1.0),
    }[kind]()


@pytest.mark.parametrize("kind", ["normal", "wide", "ties", "mostly zero", "same", "two ends"])
def test_quantiles_of_large_groups(spark, kind):
    v = values(kind, 6000)
    table = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),), (float("inf"),)], "v double").repartition(5)
    got = quantiles(table, [], "v", AT, most=40).first().q
    assert np.allclose(got, np.quantile(v, AT), rtol=1e-12)


def test_quantiles_by_key(spark):
    sizes = {"a": 3000, "b": 50, "c": 1, "d": 700, "e": 51}
    data = {k: values("normal", n, i) for i, (k, n) in enumerate(sizes.items())}
    rows = [(k, i % 2, float(x)) for k, v in data.items() for i, x in enumerate(v)] + [("none", 0, None)]
    table = spark.createDataFrame(rows, "k string, h int, v double")
    got = {r.k: r.q for r in quantiles(table, ["k"], "v", AT, most=50).collect()}
    assert set(got) - {"none"} == set(data) and all(np.allclose(got[k], np.quantile(v, AT)) for k, v in data.items())
    two = {(r.k, r.h): r.z for r in quantiles(table, ["k", "h"], "v", [0.5], "z", most=50).collect()}
    assert all(np.isclose(two[k, h][0], np.median(v[h::2])) for k, v in data.items() for h in (0, 1) if len(v[h::2]))


def test_quantiles_of_nothing(spark):
    assert quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", [0.5]).count() == 0


def test_ranks_of_one_range_look_at_its_rows_once(spark, monkeypatch):
    ranges, plain = [], quantile._with
    monkeypatch.setattr(quantile, "_with", lambda rows, state, keys: (ranges.append(state.count()), plain(rows, state, keys))[1])
    values = np.random.default_rng(3).normal(size=5_000)
    got = quantiles(spark.createDataFrame([(float(v),) for v in values], "v double"), [], "v", [0.95, 0.99], most=50).first()["q"]
    assert np.allclose(got, np.quantile(values, [0.95, 0.99])) and ranges[1] == 1  # of four ranks
