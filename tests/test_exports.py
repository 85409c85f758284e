"""Verdicts on coarse exports, from single measures and from whole fields."""

from __future__ import annotations

import numpy as np
import pytest

from flumen.operators import exports

FINE = {"spacing": 0.01, "nrms": 0.1, "pearson": 0.95, "p99_relative": 0.1, "displacement": 0.5, "core": 7.0}


@pytest.mark.parametrize(
    ("change", "score", "verdict"),
    [
        ({}, 0, "quantitative"), ({"spacing": 0.05}, 1, "quantitative"), ({"spacing": 0.081}, 2, "qualitative"), ({"spacing": 0.08}, 1, "quantitative"), ({"nrms": 0.3, "pearson": 0.8}, 2, "qualitative"), ({"nrms": 0.36, "pearson": 0.7}, 4, "qualitative"),
        ({"p99_relative": -0.4}, 1, "quantitative"), ({"displacement": 0.51, "core": 5.9}, 2, "qualitative"), ({"core": 3.9, "nrms": 0.5, "spacing": 0.05}, 5, "too coarse"), ({k: None for k in FINE}, 0, "quantitative"), ({"core": 6.0, "displacement": 0.5, "p99_relative": 0.35, "nrms": 0.2, "pearson": 0.9, "spacing": 0.04}, 0, "quantitative"),
    ],
)
def test_each_measure_counts_as_it_should(spark, change, score, verdict):
    row = FINE | change
    got = exports.verdict(spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} double" for c in row)), 10.0).first()
    assert (got.score, got.verdict) == (score, verdict) and bool(got.reasons) == (score > 0)


def whole(spark, n, step, f=1.0, key="a"):
    at = np.arange(0, n, step) / n
    bump = lambda x, y, z: np.exp(-40 * ((x - 0.3) ** 2 + (y - 0.4) ** 2 + (z - 0.5) ** 2)) + 0.7 * np.exp(-60 * ((x - 0.7) ** 2 + (y - 0.6) ** 2 + (z - 0.5) ** 2))
    rows = [(key, float(x), float(y), float(z), float(f * bump(x, y, z))) for x in at for y in at for z in at]
    return spark.createDataFrame(rows, "volume string, x double, y double, z double, swirl double")


def test_an_export_compared_with_itself_is_fine_but_for_its_cores(spark):
    f = whole(spark, 10, 1)
    found = exports.compare_exports(f, f, 30.0, 1.0)
    v = found["verdict"].first()
    assert v.nrms == 0 and abs(v.pearson - 1) < 1e-12 and v.displacement == 0 and set(v.reasons) <= {"cells across a core"}
    m = found["matches"].collect()
    assert m and all(r.a_component == r.b_component and r.size_ratio == r.peak_ratio == 1.0 for r in m)


def test_grids_with_holes_are_refused(spark):
    f = whole(spark, 4, 1)
    with pytest.raises(ValueError, match="coarse export"):
        exports.compare_exports(f, f.filter("not (x = 0 and y = 0 and z = 0)"), 1.0, 1.0)
