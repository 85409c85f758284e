from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from flumen import catalog_of_queries
from flumen.operators import pod, regrid, spectra
from flumen.sources import catalog
from flumen.sources.fields import axes_of


def test_quadrature_pair(spark):
    t = np.arange(400) / 100
    rows = [(1, float(x), 2 * math.cos(4 * math.pi * x)) for x in t] + [(2, float(x), 3 * math.sin(4 * math.pi * x)) for x in t]
    r = pod.sinusoid_pair(spark.createDataFrame(rows, "mode int, t double, a double"), 2.0).first()
    assert (r.r2_1, r.r2_2, r.amplitude_1, r.amplitude_2) == pytest.approx((1, 1, 2, 3)) and abs(r.difference) == pytest.approx(90)


def test_modal_band(spark):
    """Sinusoids of 0.5, 1 and 2 Hz, 1,000 samples at 100 Hz."""
    t = np.arange(1000) / 100
    rows = [(m, i, math.sin(2 * math.pi * f * x)) for m, f in ((1, 0.5), (2, 1.0), (3, 2.0)) for i, x in enumerate(t)]
    p = spectra.periodogram(spark.createDataFrame(rows, "mode int, i int, a double"), ["mode"], "i", "a", 100.0)
    shares = spark.createDataFrame([(1, 0.2), (2, 0.3), (3, 0.1)], "mode int, fraction double")
    r = spectra.modal_band(p, shares, 0, 1, 10.0).first()
    assert (r.band_fraction_of_total, r.band_energy, r.saved_fraction, r.last_frequency) == pytest.approx((0.5, 5, 0.6, 1))
    assert spectra.modal_band(p, shares, 0, 50, 10.0).first().band_fraction_of_total == pytest.approx(0.6)


def test_strict_regridding_spreads_missing_values(spark, samples):
    field = samples(np.arange(8).reshape(1, 2, 2, 2)).select("volume", "iz", "iy", "ix", F.when(~((F.col("iz") == 1) & (F.col("iy") == 1) & (F.col("ix") == 1)), F.col("u")).alias("u"))
    axes = axes_of(field, z="iz", y="iy", x="ix")
    targets = spark.createDataFrame([("a", 0, 0.0, 0.0, 0.5), ("a", 1, 0.5, 0.5, 0.0), ("a", 2, 9.0, 0.0, 0.0)], "volume string, target int, z double, y double, x double")
    assert {r.target: r.u for r in regrid.trilinear(field, axes, targets, ["u"]).collect()} == {0: 0.5, 1: 3.0}
    assert set(r.target for r in regrid.trilinear_strict(field, axes, targets, ["u"]).collect()) == {0, 1}


def test_settings():
    assert catalog.inherited_mode({"invalid_samples": "zero"}) == "zero" and catalog.inherited_mode({}) == "nan"
    assert catalog.phase_list("0, 370,-90") == [0, 10, 270] and catalog.component_list("u,w,u") == ["u", "w"]
    with pytest.raises(ValueError):
        catalog.component_list("q")


def test_entry_is_registered():
    known, sql = catalog_of_queries.queries(), catalog_of_queries.oracle_sql()
    assert set(sql) <= set(known) and len(known) > 80 and set(known) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
