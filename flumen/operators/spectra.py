"""Spectra of evenly sampled signals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.lineage import cut
from ..plans.order import few


def window_of(n: int, kind: str) -> np.ndarray:
    """Periodic Hann, or boxcar."""
    if kind not in ("hann", "boxcar"):
        raise ValueError("a window is hann or boxcar")
    return np.ones(n) if kind == "boxcar" else 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


#: Values of a record that is one array in a task; longer ones are transformed in parts.
MOST = 1 << 20


def periodogram(signal: DataFrame, keys: list[str], index: str, value: str, fs: float, kind: str = "boxcar", most: int | None = MOST) -> DataFrame:
    """One-sided power density of each key's values (index 0 .. n - 1), less their mean: k, frequency, psd. A record of up
    to `most` values becomes one array, which numpy transforms; many records go in one batch. Longer ones are transformed
    in parts that meet in two shuffles. most=None says that records are known to be short."""
    window_of(1, kind)
    if most is None:
        return _short(signal, keys, index, value, fs, kind)
    sizes = cut(signal.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg(F.col(value).cast("double")).alias("_mean")))
    large = sizes.filter(F.col("_n") > most)
    if large.isEmpty():
        return _short(signal, keys, index, value, fs, kind)
    if not keys:  # one record
        return _long(signal.crossJoin(F.broadcast(large)), keys, index, value, fs, kind)
    short = _short(signal.join(large.select(*keys), keys, "left_anti"), keys, index, value, fs, kind)
    return short.unionByName(_long(signal.join(large, keys), keys, index, value, fs, kind))


def _factor(n: int) -> int:
    """The largest divisor of n that is not over its root."""
    return next(d for d in range(math.isqrt(n), 0, -1) if n % d == 0)


def _transformed(rows: DataFrame, keys: list[str], sign: int) -> DataFrame:
    """Discrete Fourier transforms of rows (keys, _m, _m1, i, re, im; an i that is missing is 0), _m1 a divisor of the length
    _m: each of the _m / _m1 combs of values is transformed by itself, turned, and transformed across the combs."""

    def part(across: bool):
        def run(group: pa.Table) -> pa.Table:
            m, m1 = group["_m"][0].as_py(), group["_m1"][0].as_py()
            comb = group["_comb"][0].as_py()
            x = np.zeros(m // m1 if across else m1, complex)
            x[group["_at"].to_numpy()] = group["re"].to_numpy() + 1j * group["im"].to_numpy()
            y = np.fft.fft(x) if sign < 0 else np.fft.ifft(x) * len(x)
            k = np.arange(len(y))
            if not across:
                y = y * np.exp(sign * 2j * np.pi * ((k * comb) % m) / m)
            # Within a comb k is the place of the next step's comb; across them it completes the frequency.
            out = {"_comb": k, "_at": np.full(len(k), comb)} if not across else {"_comb": np.full(len(k), comb), "_at": k}
            own = {c: pa.array([group[c][0].as_py()] * len(k), group.schema.field(c).type) for c in (*keys, "_m", "_m1")}
            return pa.table(own | out | {"re": y.real.copy(), "im": y.imag.copy()})

        return run

    kinds = StructType([rows.schema[k] for k in keys]).simpleString()[7:-1].replace(":", " ")
    schema = ", ".join(x for x in (kinds, "_m long, _m1 long, _comb long, _at long, re double, im double") if x)
    step = F.col("_m") / F.col("_m1")
    first = rows.select(*keys, "_m", "_m1", F.pmod("i", step.cast("long")).alias("_comb"), F.floor(F.col("i") / step).cast("long").alias("_at"), "re", "im")
    second = first.groupBy(*keys, "_comb").applyInArrow(part(False), schema).groupBy(*keys, "_comb").applyInArrow(part(True), schema)
    return second.select(*keys, "_m", "_m1", (F.col("_comb") + F.col("_m1") * F.col("_at")).alias("i"), "re", "im")


def _long(signal: DataFrame, keys: list[str], index: str, value: str, fs: float, kind: str) -> DataFrame:
    """Periodograms of long records (with _n and _mean). Lengths without a divisor near their root become a convolution with
    a chirp, whose length is a power of two."""
    i, n = F.col(index).cast("long"), F.col("_n")
    w = F.lit(1.0) if kind == "boxcar" else 0.5 - 0.5 * F.cos(2 * math.pi * i / n)
    x = cut(signal.select(*keys, n.alias("_n"), i.alias("i"), ((F.col(value).cast("double") - F.col("_mean")) * w).alias("re"), w.alias("_w")))
    sizes = x.groupBy(*keys).agg(F.first("_n").alias("_n"), F.sum(F.col("_w") * F.col("_w")).alias("_ww"))
    lengths = [r[0] for r in sizes.select("_n").distinct().collect()]  # of long records only
    plans = []
    for length in lengths:
        d = _factor(length)
        even = d * 64 >= length // d
        m = length if even else 1 << (2 * length - 1).bit_length()
        plans.append((length, m, d if even else 1 << (m.bit_length() - 1) // 2, even))
    x = x.join(F.broadcast(x.sparkSession.createDataFrame(plans, "_n long, _m long, _m1 long, _even boolean")), "_n").withColumn("im", F.lit(0.0))
    base = [*keys, "_m", "_m1", "i", "re", "im"]
    found = _transformed(x.filter("_even").select(*base), keys, -1)
    rest = x.filter("not _even")
    if not rest.isEmpty():
        angle = math.pi * F.pmod(F.col("i") * F.col("i"), 2 * F.col("_n")) / F.col("_n")
        turned = lambda re, im, c, s: [(re * c - im * s).alias("re"), (re * s + im * c).alias("im")]
        a = _transformed(rest.select(*keys, "_m", "_m1", "i", *turned(F.col("re"), F.col("im"), F.cos(angle), -F.sin(angle))), keys, -1)
        mirror = F.explode(F.when(F.col("i") > 0, F.array("i", F.col("_m") - F.col("i"))).otherwise(F.array("i"))).alias("j")
        chirp = rest.select(*keys, "_m", "_m1", F.cos(angle).alias("re"), F.sin(angle).alias("im"), mirror, "i").select(*keys, "_m", "_m1", F.col("j").alias("i"), "re", "im")
        b = _transformed(chirp, keys, -1).select(*keys, "i", F.col("re").alias("_c"), F.col("im").alias("_s"))
        product = a.join(b, [*keys, "i"]).select(*keys, "_m", "_m1", "i", *turned(F.col("re"), F.col("im"), F.col("_c"), F.col("_s")))
        # The last turn has magnitude 1 and no part in the density.
        back = _transformed(product, keys, 1)
        found = found.unionByName(back.select(*keys, "_m", "_m1", "i", (F.col("re") / F.col("_m")).alias("re"), (F.col("im") / F.col("_m")).alias("im")))
    out = (found.join(sizes, keys) if keys else found.crossJoin(F.broadcast(sizes))).filter(F.col("i") <= F.floor(F.col("_n") / 2))
    once = (F.col("i") == 0) | (2 * F.col("i") == F.col("_n"))
    psd = F.when(once, 1.0).otherwise(2.0) * (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (fs * F.col("_ww"))
    return out.select(*keys, F.col("i").alias("k"), (F.col("i") * fs / F.col("_n")).alias("frequency"), psd.alias("psd"))


def _short(signal: DataFrame, keys: list[str], index: str, value: str, fs: float, kind: str) -> DataFrame:
    by = signal.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(index).cast("long").alias("i"), F.col(value).cast("double").alias("x")))).alias("x"))

    @F.pandas_udf("array<double>")
    def density(records: pd.Series) -> pd.Series:
        def one(x: np.ndarray) -> np.ndarray:
            n, w = len(x), window_of(len(x), kind)
            f = np.fft.rfft((x - x.mean()) * w)
            twice = np.full(len(f), 2.0)
            twice[0] = 1.0
            if n % 2 == 0:
                twice[-1] = 1.0
            return twice * (f.real**2 + f.imag**2) / (fs * (w * w).sum())

        return records.map(one)

    out = by.select(*keys, F.size("x").alias("n"), F.posexplode(density(F.transform("x", lambda p: p["x"]))).alias("k", "psd"))
    return out.select(*keys, F.col("k").cast("long").alias("k"), (F.col("k") * fs / F.col("n")).alias("frequency"), "psd")


def segments(signal: DataFrame, keys: list[str], index: str, value: str, length: int, step: int) -> DataFrame:
    """keys, segment, i, value: every full run of `length` values, one starting each `step`."""
    w = Window.partitionBy(*keys)
    x = signal.select(*keys, F.col(index).cast("long").alias("i"), F.col(value).alias(value)).withColumn("n", F.count("*").over(w))
    first = F.greatest(F.ceil((F.col("i") - length + 1) / step), F.lit(0)).cast("long")
    last = F.least(F.floor(F.col("i") / step), F.floor((F.col("n") - length) / step)).cast("long")
    x = x.filter((F.col("n") >= length)).withColumns({"s0": first, "s1": last}).filter("s0 <= s1")
    return x.select(*keys, F.explode(F.sequence("s0", "s1")).alias("segment"), "i", value).withColumn("i", F.col("i") - F.col("segment") * step)


def welch(signal: DataFrame, keys: list[str], index: str, value: str, fs: float, length: int, overlap: float = 0.5, pool: list[str] | None = None) -> DataFrame:
    """Mean of the segments' Hann periodograms; segments of all keys that `pool` puts together count alike."""
    step = length - int(length * overlap)
    p = periodogram(segments(signal, keys, index, value, length, step), [*keys, "segment"], "i", value, fs, "hann", most=None)
    return p.groupBy(*(keys if pool is None else pool), "k", "frequency").agg(F.avg("psd").alias("psd"), F.count("*").alias("n_segments"))


def peak(spectrum: DataFrame, keys: list[str]) -> DataFrame:
    """Frequency of the largest density but that of frequency 0; the lowest of equal ones."""
    return spectrum.filter("k > 0").groupBy(*keys).agg(F.max_by("frequency", F.struct(F.col("psd"), -F.col("frequency"))).alias("peak"), F.max("psd").alias("psd"))


def band_energy(spectrum: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """Energy within [low, high] and its share of all, over evenly spaced frequencies without 0."""
    w = Window.partitionBy(*keys).orderBy("k")
    df = F.max("df").alias("df")
    s = spectrum.withColumn("df", F.col("frequency") - F.lag("frequency").over(w))
    inside = (F.col("k") > 0) & F.col("frequency").between(low, high)
    out = s.groupBy(*keys).agg(F.sum(F.when(inside, F.col("psd"))).alias("inside"), F.sum(F.when(F.col("k") > 0, F.col("psd"))).alias("all"), df, F.max(F.when(inside, F.col("frequency"))).alias("last_frequency"))
    return out.select(*keys, (F.coalesce("inside", F.lit(0.0)) * F.col("df")).alias("band_energy"), F.try_divide(F.coalesce("inside", F.lit(0.0)), F.col("all")).alias("band_fraction"), "last_frequency")


def band_table(spectrum: DataFrame, keys: list[str], bands: DataFrame) -> DataFrame:
    """Energy in each of a handful of bands (band, low, high) by key, bin centres within a small part of a bin."""
    w = Window.partitionBy(*keys).orderBy("k")
    s = spectrum.withColumn("df", F.coalesce(F.col("frequency") - F.lag("frequency").over(w), F.lead("frequency").over(w) - F.col("frequency")))
    s = s.withColumn("whole", F.sum(F.when(F.col("k") > 0, F.col("psd") * F.col("df"))).over(Window.partitionBy(*keys)))
    met = s.filter("k > 0").join(few(bands), F.col("frequency").between(F.col("low") - 1e-5 * F.col("df"), F.col("high") + 1e-5 * F.col("df")))
    out = met.groupBy(*keys, "band").agg(F.sum(F.col("psd") * F.col("df")).alias("energy"), F.max("whole").alias("whole"), F.count("*").alias("n_bins"))
    return out.withColumn("fraction", F.try_divide("energy", "whole")).drop("whole")


def modal_band(spectrum: DataFrame, shares: DataFrame, low: float, high: float, total: float) -> DataFrame:
    """Energy of a band over all modes: each mode's share (mode, fraction) times the part of its spectrum (mode, k,
    frequency, psd) that lies in the band; as energy, of the saved modes and of all fluctuations (total)."""
    parts = band_energy(spectrum, ["mode"], low, high).join(shares, "mode")
    out = parts.agg(F.sum(F.col("fraction") * F.col("band_fraction")).alias("band_fraction_of_total"), F.sum("fraction").alias("saved_fraction"), F.max("last_frequency").alias("last_frequency"))
    return out.withColumns({"band_energy": F.col("band_fraction_of_total") * total, "band_fraction_of_saved": F.try_divide("band_fraction_of_total", "saved_fraction")})
