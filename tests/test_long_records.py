"""Records that no task holds are transformed in parts, as numpy does whole ones."""

from __future__ import annotations

import numpy as np
import pytest

from flumen.operators import spectra


def plain(x, fs, kind):
    n, w = len(x), spectra.window_of(len(x), kind)
    f = np.abs(np.fft.rfft((x - x.mean()) * w)) ** 2
    twice = np.full(len(f), 2.0)
    twice[0] = 1.0
    if n % 2 == 0:
        twice[-1] = 1.0
    return twice * f / (fs * (w * w).sum())


@pytest.mark.parametrize("kind", ["boxcar", "hann"])
def test_long_records_agree_with_numpy(spark, kind):
    """Lengths with divisors, a prime, twice a large prime, a power of two, and a short one."""
    r = np.random.default_rng(1)
    records = {n: r.normal(size=n) + 3 for n in (360, 509, 2 * 509, 512, 50, 1)}
    table = spark.createDataFrame([(n, i, float(v)) for n, x in records.items() for i, v in enumerate(x)], "record long, i int, x double").repartition(4)
    got = spectra.periodogram(table, ["record"], "i", "x", 4.0, kind, most=100).toPandas()
    for n, x in records.items():
        g = got[got.record == n].sort_values("k")
        assert list(g.k) == list(range(n // 2 + 1)) and np.allclose(g.frequency, np.arange(n // 2 + 1) * 4.0 / n)
        if n > 1 or kind == "boxcar":
            assert np.allclose(g.psd, plain(x, 4.0, kind), rtol=1e-9, atol=1e-12)


def test_one_long_record_without_keys(spark):
    x = np.sin(np.arange(600) * 2 * np.pi * 7 / 600)
    table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double")
    got = spectra.periodogram(table, [], "i", "x", 1.0, most=10).toPandas().sort_values("k")
    assert int(got.psd.argmax()) == 7 and np.allclose(got.psd, plain(x, 1.0, "boxcar"), atol=1e-9)
