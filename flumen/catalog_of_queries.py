"""Registry of the engine's own queries over the general tables, each with the same question in plain SQL.

Whole numbers come out as long, measured ones rounded to five places on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.validity import finite, speed
from .operators import compare, correlation, energy, fill, multi, phase, pod, probe, regrid, spectra, stats, vortex, wake
from .plans import workflows
from .plans.lineage import cut
from .plans.quantile import quantiles
from .sources import fields
from .sources.fields import VOXEL, event_signal, lineitem_field, snapshots
from .sources.text import case_label

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Forcing of the field view: one turn in 90 days, eight bins, and an offset that keeps days off the bins' edges; of the
#: signal view: one turn in a day.
PERIOD, BINS, DAY, OFFSET = 90.0, 8, 86_400.0, 0.05
U_INF = 50.0


#: Added before rounding: means of short decimals often lie on a rounding edge, where the order of a sum decides.
NUDGE = 1.37e-7


def _rounded(c: Column) -> Column:
    return F.round(c + NUDGE, 5) + 0.0


def _tidy(df: DataFrame) -> DataFrame:
    cast = {"int": lambda c: c.cast("long"), "smallint": lambda c: c.cast("long"), "double": _rounded, "float": lambda c: _rounded(c.cast("double"))}
    return df.select(*((cast[t](F.col(c)) if t in cast else F.col(c)).alias(c) for c, t in df.dtypes))


def _sql(ctes: list[str], body: str, out: str) -> str:
    """out: names, with :i for a whole and :d for a measured number."""
    put = {"i": lambda n: f"CAST({n} AS BIGINT) AS {n}", "d": lambda n: f"ROUND(CAST({n} AS DOUBLE) + {NUDGE:.9f}, 5) + 0.0 AS {n}", "": lambda n: n}
    cols = ", ".join(put[k](n) for n, _, k in (x.partition(":") for x in out.split()))
    head = f"WITH {', '.join(ctes)} " if ctes else ""
    return f"{head}SELECT {cols} FROM ({body}) AS result"


def query(name: str, ctes: list[str] | None = None, body: str | None = None, out: str = "") -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[name] = lambda spark, sf_dir: _tidy(f(spark, sf_dir))
        if body is not None:
            _SQL[name] = _sql(ctes or [], body, out)
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


FIELD = """field AS (SELECT l_returnflag AS volume, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS ti,
 CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS t,
 CAST(l_partkey % 4 AS INTEGER) AS iz, CAST(l_suppkey % 5 AS INTEGER) AS iy, CAST(l_linenumber AS INTEGER) AS ix,
 CASE WHEN l_orderkey % 11 = 3 THEN 'NaN'::DOUBLE ELSE l_quantity END AS u, l_extendedprice / 1000 AS v, l_discount AS w,
 l_orderkey AS "row", l_tax = 0 AS filled FROM lineitem)"""
TIMES = "times AS (SELECT volume, count(DISTINCT ti) AS n_times FROM field GROUP BY volume)"
MEAN = """mean AS (SELECT volume, iz, iy, ix, n_times, avg(CASE WHEN isfinite(u) THEN u END) AS u_mean, avg(v) AS v_mean, avg(w) AS w_mean,
 count(CASE WHEN isfinite(u) THEN 1 END) AS u_count, count(v) AS v_count, count(w) AS w_count FROM field JOIN times USING (volume) GROUP BY ALL)"""
PHASED = f"""phased AS (SELECT *, least(CAST(floor(phase / (2 * pi() / {BINS})) AS INTEGER), {BINS - 1}) AS phase_bin
 FROM (SELECT *, turn - 2 * pi() * floor(turn / (2 * pi())) AS phase FROM (SELECT *, 2 * pi() * t / {PERIOD} + {OFFSET} AS turn FROM field)))"""
CYCLE = f"floor(t / {PERIOD} + {OFFSET} / (2 * pi()))"
SIGNAL = """signal AS (SELECT event_type AS series, user_id, event_id AS id, epoch_us(CAST(ts AS TIMESTAMP)) / 1e6 AS t,
 CASE WHEN (event_id * 7919) % 10 >= 3 THEN value END AS value FROM events)"""
SNAP = "snaps AS (SELECT vec_id AS snapshot, unnest(range(len(embedding))) AS dof, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"
M, FM = [FIELD, TIMES, MEAN], [FIELD, TIMES]


def _mean(spark: SparkSession, sf: str) -> DataFrame:
    return stats.temporal_mean(lineitem_field(spark, sf))


def _phased(spark: SparkSession, sf: str) -> DataFrame:
    return phase.with_phase(lineitem_field(spark, sf), BINS, 1 / PERIOD, offset=OFFSET)


# Scans and views


@query("check_samples", [FIELD], (
    "SELECT volume, sum(n) n_samples, count(DISTINCT ti) n_times, count(DISTINCT iz) nz, count(DISTINCT iy) ny, count(DISTINCT ix) nx, sum(n - 1) "
    "n_repeated, count(DISTINCT ti) * count(DISTINCT iz) * count(DISTINCT iy) * count(DISTINCT ix) - count(*) n_missing FROM (SELECT volume, ti, iz, iy, "
    "ix, count(*) n FROM field GROUP BY ALL) GROUP BY volume"
), "volume n_samples:i n_times:i nz:i ny:i nx:i n_repeated:i n_missing:i")
def check_samples(spark, sf):
    return fields.check_samples(lineitem_field(spark, sf))


@query("frame_scan", [FIELD], "SELECT *, sqrt(u * u + v * v + w * w) AS speed, sqrt(u * u + v * v) AS in_plane FROM field WHERE ti = 2000 AND isfinite(u)", "volume iz:i iy:i ix:i row:i u:d v:d w:d speed:d in_plane:d".replace(" row:i", ' "row":i'))
def frame_scan(spark, sf):
    f = fields.frame(lineitem_field(spark, sf), 2000).filter(finite(F.col("u")))
    return f.select("volume", "iz", "iy", "ix", "row", "u", "v", "w", speed(F.col("u"), F.col("v"), F.col("w")).alias("speed"), speed(F.col("u"), F.col("v")).alias("in_plane"))


@query("strided_frames", [FIELD], "SELECT volume, ti, count(*) n, sum(v) v FROM field WHERE ti >= 100 AND ti < 2000 AND (ti - 100) % 7 = 0 GROUP BY ALL", "volume ti:i n:i v:d")
def strided_frames(spark, sf):
    return fields.frames(lineitem_field(spark, sf), 100, 2000, 7).groupBy("volume", "ti").agg(F.count("*").alias("n"), F.sum("v").alias("v"))


@query("axis_description", [FIELD], """SELECT volume, axis, count(*) n, min(coord) low, max(coord) high, median(step) step_median, min(step) step_min, max(step) step_max,
 coalesce(max(step) - min(step) <= 2 * 0.002 * abs(median(step)), true) uniform FROM (SELECT *, coord - lag(coord) OVER (PARTITION BY volume, axis ORDER BY coord) step FROM (
 SELECT DISTINCT volume, 't' axis, t coord FROM field UNION ALL SELECT DISTINCT volume, 'iz', CAST(iz AS DOUBLE) FROM field UNION ALL SELECT DISTINCT volume, 'iy', CAST(iy AS DOUBLE) FROM field UNION ALL SELECT DISTINCT volume, 'ix', CAST(ix AS DOUBLE) FROM field)) GROUP BY volume, axis""", "volume axis n:i low:d high:d step_median:d step_min:d step_max:d uniform")
def axis_description(spark, sf):
    return fields.describe(lineitem_field(spark, sf))


@query("region_view", [FIELD], (
    "SELECT volume, count(*) n, count(CASE WHEN NOT filled AND isfinite(u) THEN 1 END) n_u, avg(CASE WHEN NOT filled AND isfinite(u) THEN u * 0.001 END) "
    "u, max(t * 0.5) t FROM field WHERE ix BETWEEN 2 AND 5 AND t BETWEEN 1700 AND 2900 GROUP BY volume"
), "volume n:i n_u:i u:d t:d")
def region_view(spark, sf):
    f = fields.selected(lineitem_field(spark, sf), 0.001, 0.5, ix=(2, 5), t=(1700, 2900))
    ok = finite(F.col("u"))
    return f.groupBy("volume").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_u"), F.avg(F.when(ok, F.col("u"))).alias("u"), F.max("t").alias("t"))


@query("validity_reader", [FIELD], "SELECT volume, iz, count(*) n, count(CASE WHEN isfinite(u) AND u <> 7 AND v <> 7 AND w <> 7 AND NOT filled THEN 1 END) n_valid FROM field GROUP BY ALL", "volume iz:i n:i n_valid:i")
def validity_reader(spark, sf):
    f = fields.with_validity(lineitem_field(spark, sf), "nan", (7.0,), True)
    return f.groupBy("volume", "iz").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"))


@query("valid_counts", [FIELD], (
    "SELECT volume, count(*) n, count(CASE WHEN isfinite(u) AND u <> 0 THEN 1 END) u_valid, count(CASE WHEN v <> 0 THEN 1 END) v_valid, count(CASE WHEN w "
    "<> 0 THEN 1 END) w_valid, count(CASE WHEN isfinite(u) AND (u <> 0 OR v <> 0 OR w <> 0) THEN 1 END) vector_valid FROM field GROUP BY volume"
), "volume n:i u_valid:i v_valid:i w_valid:i vector_valid:i")
def valid_counts(spark, sf):
    return fields.counted(lineitem_field(spark, sf), "zero-or-nan")


@query("center_slab", [FIELD], """SELECT volume, iy, count(*) n FROM field JOIN (SELECT volume, iy AS mid FROM (SELECT DISTINCT volume, iy FROM field) QUALIFY row_number() OVER (PARTITION BY volume ORDER BY abs(iy - 2.2), iy) = 1) USING (volume)
 JOIN (SELECT volume, min(iy) lo, max(iy) hi FROM field GROUP BY volume) USING (volume) WHERE mid - 1 >= lo AND mid + 1 <= hi AND abs(iy - mid) <= 1 GROUP BY ALL""", "volume iy:i n:i")
def center_slab(spark, sf):
    return fields.center_slab(lineitem_field(spark, sf), 3, "y", 2.2).groupBy("volume", "iy").agg(F.count("*").alias("n"))


@query("nearest_plane", [FIELD], "SELECT volume, iy AS idx FROM (SELECT DISTINCT volume, iy FROM field) QUALIFY row_number() OVER (PARTITION BY volume ORDER BY abs(iy - 2.5), iy) = 1", "volume idx:i")
def nearest_plane(spark, sf):
    axes = fields.axes_of(lineitem_field(spark, sf), y="iy")
    return fields.nearest_index(axes, 2.5).select("volume", "idx")


# Statistics


@query("temporal_mean", M, f"""SELECT volume, iz, iy, ix, u_count, v_count, w_count, u_mean, v_mean, w_mean, sqrt(u_mean * u_mean + v_mean * v_mean + w_mean * w_mean) speed_from_mean, u_mean / {U_INF} u_over_u_inf,
 ({U_INF} - u_mean) / {U_INF} wake_deficit, coalesce(u_mean / {U_INF} < 0.9, false) wake_mask_u09 FROM (SELECT volume, iz, iy, ix, u_count, v_count, w_count, CASE WHEN u_count > 0 AND u_count >= ceil(0.01 * n_times) THEN u_mean END u_mean,
 CASE WHEN v_count > 0 AND v_count >= ceil(0.01 * n_times) THEN v_mean END v_mean, CASE WHEN w_count > 0 AND w_count >= ceil(0.01 * n_times) THEN w_mean END w_mean FROM mean)""", "volume iz:i iy:i ix:i u_count:i v_count:i w_count:i u_mean:d v_mean:d w_mean:d speed_from_mean:d u_over_u_inf:d wake_deficit:d wake_mask_u09")
def temporal_mean(spark, sf):
    return stats.temporal_mean(lineitem_field(spark, sf), min_fraction=0.01, u_inf=U_INF).drop("n_times")


@query("temporal_mean_vector", [FIELD], (
    "SELECT volume, iz, iy, ix, avg(CASE WHEN ok THEN v END) v_mean, avg(CASE WHEN ok THEN w END) w_mean, count(CASE WHEN ok THEN 1 END) v_count FROM "
    "(SELECT *, isfinite(u) AND (u <> 0 OR v <> 0 OR w <> 0) ok FROM field) GROUP BY ALL"
), "volume iz:i iy:i ix:i v_mean:d w_mean:d v_count:i")
def temporal_mean_vector(spark, sf):
    return stats.temporal_mean(lineitem_field(spark, sf), "zero-or-nan", "vector").select(*VOXEL, "v_mean", "w_mean", "v_count")


@query("cut_by_fraction", M, (
    "SELECT volume, iz, iy, ix, u_count, CASE WHEN u_count > 0 AND u_count >= ceil(0.05 * n_times) THEN u_mean END u_mean, CASE WHEN v_count >= ceil(0.05 "
    "* n_times) THEN v_mean END v_mean FROM mean"
), "volume iz:i iy:i ix:i u_count:i u_mean:d v_mean:d")
def cut_by_fraction(spark, sf):
    return stats.cut_by_fraction(_mean(spark, sf), 0.05).select(*VOXEL, "u_count", "u_mean", "v_mean")


@query("kinetic_energy", [FIELD], (
    "SELECT volume, iz, iy, ix, u_prime2, v_prime2, w_prime2, u_prime2_count, 0.5 * (u_prime2 + v_prime2 + w_prime2) tke FROM (SELECT volume, iz, iy, ix, "
    "var_pop(CASE WHEN isfinite(u) THEN u END) u_prime2, var_pop(v) v_prime2, var_pop(w) w_prime2, count(CASE WHEN isfinite(u) THEN 1 END) u_prime2_count "
    "FROM field GROUP BY ALL)"
), "volume iz:i iy:i ix:i u_prime2:d v_prime2:d w_prime2:d u_prime2_count:i tke:d")
def kinetic_energy(spark, sf):
    f = lineitem_field(spark, sf)
    return stats.kinetic_energy(f, stats.temporal_mean(f)).select(*VOXEL, "u_prime2", "v_prime2", "w_prime2", "u_prime2_count", "tke")


STRESS = ", ".join(f"avg(CASE WHEN {'isfinite(f.u)' if 'u' in ab else 'true'} THEN (f.{ab[0]} - {ab[0]}_mean) * (f.{ab[1]} - {ab[1]}_mean) END) {ab}_stress" for ab in stats.STRESSES)


@query("reynolds_stresses", M, f"SELECT volume, iz, iy, ix, {STRESS} FROM field f JOIN mean USING (volume, iz, iy, ix) GROUP BY ALL", "volume iz:i iy:i ix:i " + " ".join(f"{ab}_stress:d" for ab in stats.STRESSES))
def reynolds_stresses(spark, sf):
    f = lineitem_field(spark, sf)
    return stats.reynolds_stresses(f, stats.temporal_mean(f)).select(*VOXEL, *(f"{ab}_stress" for ab in stats.STRESSES))


@query("turbulence_intensity", [FIELD], (
    "SELECT volume, ix, u_rms, u_count, CASE WHEN u_count >= 2 AND abs(u_mean) > 0 THEN 100 * u_rms / abs(u_mean) END u_ti, CASE WHEN u_count >= 2 AND "
    "abs(u_mean) > 0 THEN 100 * w_rms / abs(u_mean) END w_ti FROM (SELECT volume, ix, avg(u) u_mean, stddev_pop(u) u_rms, stddev_pop(w) w_rms, count(u) "
    "u_count FROM field WHERE isfinite(u) GROUP BY ALL)"
), "volume ix:i u_rms:d u_count:i u_ti:d w_ti:d")
def turbulence_intensity(spark, sf):
    return stats.moments(lineitem_field(spark, sf), ["volume", "ix"]).select("volume", "ix", "u_rms", "u_count", "u_ti", "w_ti")


@query("frame_stats", [FIELD], (
    "SELECT volume, ti, min(u) u_min, max(u) u_max, min(v) v_min, max(v) v_max, min(w) w_min, max(w) w_max, avg(sqrt(u * u + v * v + w * w)) speed_mean, "
    "max(sqrt(u * u + v * v + w * w)) speed_max FROM (SELECT volume, ti, CASE WHEN isfinite(u) THEN u END u, v, w FROM field) GROUP BY ALL"
), "volume ti:i u_min:d u_max:d v_min:d v_max:d w_min:d w_max:d speed_mean:d speed_max:d")
def frame_stats(spark, sf):
    return stats.frame_stats(lineitem_field(spark, sf))


VOX = (
    "vox AS (SELECT volume, iz, iy, ix, avg(CASE WHEN isfinite(u) THEN u END) u_mean, avg(v) v_mean, avg(w) w_mean, var_pop(CASE WHEN isfinite(u) THEN u "
    "END) u_prime2, 0.5 * (var_pop(CASE WHEN isfinite(u) THEN u END) + var_pop(v) + var_pop(w)) tke FROM field GROUP BY ALL)"
)


@query("plane_profiles", [FIELD, VOX], "SELECT *, sqrt(u_var) / nullif(abs(u_mean), 0) ti FROM (" + " UNION ALL ".join((
    f"SELECT volume, '{a}' axis, i{a} idx, count(u_mean) n, avg(u_mean) u_mean, avg(v_mean) v_mean, avg(w_mean) w_mean, avg(u_prime2) u_var, avg(tke) tke "
    f"FROM vox GROUP BY volume, i{a}"
) for a in "xyz") + ")", "volume axis idx:i n:i u_mean:d v_mean:d w_mean:d u_var:d tke:d ti:d")
def plane_profiles(spark, sf):
    f = lineitem_field(spark, sf)
    mean = stats.temporal_mean(f)
    return stats.plane_profiles(mean, stats.kinetic_energy(f, mean))


@query("stationarity_blocks", [FIELD, VOX], (
    "SELECT volume, block, count(*) n_voxels, avg(shift) mean_shift, avg(var) mean_var FROM (SELECT volume, iz, iy, ix, block, avg(u - u_mean) shift, "
    "var_pop(u) var FROM (SELECT *, CASE WHEN ti < 700 THEN 0 WHEN ti < 1100 THEN 1 WHEN ti < 1500 THEN 2 ELSE 3 END block FROM field WHERE ti BETWEEN 300 "
    "AND 1899 AND isfinite(u)) JOIN vox USING (volume, iz, iy, ix) GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL"
), "volume block:i n_voxels:i mean_shift:d mean_var:d")
def stationarity_blocks(spark, sf):
    f = lineitem_field(spark, sf)
    return stats.blocks(f, stats.temporal_mean(f), 4, 300, 1899)


@query("plane_statistics", M, "SELECT volume, ix, avg(u_mean) mean, stddev_pop(u_mean) std, count(u_mean) n FROM mean GROUP BY ALL", "volume ix:i mean:d std:d n:i")
def plane_statistics(spark, sf):
    return stats.plane_stats(_mean(spark, sf), "u_mean", ["volume", "ix"])


@query("component_coverage", M, " UNION ALL ".join(f"SELECT volume, iz, iy, ix, '{c}' component, {c}_mean mean, {c}_count \"count\", {c}_count > 0 AND {c}_count >= ceil(0.04 * n_times) accepted FROM mean" for c in "uvw"), 'volume iz:i iy:i ix:i component mean:d "count":i accepted')
def component_coverage(spark, sf):
    return stats.coverage_at(lineitem_field(spark, sf), "nan", 0.04).drop("n_times")


@query("display_limits", [FIELD], "SELECT volume, quantile_cont(v, 0.01) p01, quantile_cont(v, 0.99) p99, min(v) low, max(v) high, max(abs(v)) most FROM field GROUP BY volume", "volume p01:d p99:d low:d high:d most:d")
def display_limits(spark, sf):
    return stats.limits(lineitem_field(spark, sf), "v", ["volume"])


@query("precision_statistics", [FIELD], (
    "SELECT volume, count(*) n, avg(d) mean, quantile_cont(d, 0.95) p95, quantile_cont(d, 0.99) p99, max(d) \"max\" FROM (SELECT volume, abs(v - round(v, "
    "1)) d FROM field) GROUP BY volume"
), 'volume n:i mean:d p95:d p99:d "max":d')
def precision_statistics(spark, sf):
    return stats.difference_stats(lineitem_field(spark, sf).withColumn("coarse", F.round("v", 1)), "v", "coarse", ["volume"])


# Phase


LONG = (
    "long AS (SELECT volume, iz, iy, ix, ti, phase_bin, 'u' component, CASE WHEN isfinite(u) THEN u END x FROM phased UNION ALL SELECT volume, iz, iy, ix, "
    "ti, phase_bin, 'v', v FROM phased UNION ALL SELECT volume, iz, iy, ix, ti, phase_bin, 'w', w FROM phased)"
)
AVG = """averages AS (SELECT volume, iz, iy, ix, component, phase_bin, CASE WHEN n > 0 AND n >= ceil(0.001 * bin_frames) THEN s / n END phase_mean, n phase_count, bin_frames, sum(s) OVER w / sum(n) OVER w mean
 FROM (SELECT volume, iz, iy, ix, component, phase_bin, sum(x) s, count(x) n FROM long GROUP BY ALL) JOIN (SELECT volume, phase_bin, count(DISTINCT ti) bin_frames FROM phased GROUP BY ALL) USING (volume, phase_bin) WINDOW w AS (PARTITION BY volume, iz, iy, ix, component))"""
PH = [FIELD, PHASED, LONG, AVG]


def _averages(spark: SparkSession, sf: str) -> DataFrame:
    return phase.phase_average(_phased(spark, sf), min_fraction=0.001)


@query("phase_average", PH, (
    f"SELECT *, phase_mean - mean coherent, CASE WHEN component = 'u' THEN ({U_INF} - phase_mean) / {U_INF} END phase_deficit, CASE WHEN component = 'u' "
    f"THEN -(phase_mean - mean) / {U_INF} END coherent_deficit FROM averages"
), "volume iz:i iy:i ix:i component phase_bin:i phase_mean:d phase_count:i bin_frames:i mean:d coherent:d phase_deficit:d coherent_deficit:d")
def phase_average(spark, sf):
    return phase.phase_average(_phased(spark, sf), min_fraction=0.001, u_inf=U_INF)


HARM = f"""SELECT *, sqrt(a * a + b * b) amplitude, my - a * mc - b * ms AS "offset", CASE WHEN yy > 1e-24 THEN (a * cy + b * sy) / yy END r2 FROM (SELECT *, CASE WHEN n >= 3 AND cc * ss - cs * cs > 1e-10 THEN (cy * ss - sy * cs) / (cc * ss - cs * cs) END a,
 CASE WHEN n >= 3 AND cc * ss - cs * cs > 1e-10 THEN (sy * cc - cy * cs) / (cc * ss - cs * cs) END b FROM (SELECT volume, iz, iy, ix, component, count(y) n, avg(y) my, avg(c) mc, avg(s) ms, covar_pop(c, c) cc, covar_pop(s, s) ss, covar_pop(c, s) cs, covar_pop(c, y) cy, covar_pop(s, y) sy, var_pop(y) yy
 FROM (SELECT volume, iz, iy, ix, component, phase_mean y, cos((phase_bin + 0.5) * 2 * pi() / {BINS}) c, sin((phase_bin + 0.5) * 2 * pi() / {BINS}) s FROM averages WHERE phase_mean IS NOT NULL) GROUP BY ALL))"""


@query("first_harmonic", PH, HARM, 'volume iz:i iy:i ix:i component n:i "offset":d a:d b:d amplitude:d r2:d')
def first_harmonic(spark, sf):
    return phase.first_harmonic(_averages(spark, sf), BINS).select(*VOXEL, "component", "n", "offset", "a", "b", "amplitude", "r2")


@query("phase_coverage", [FIELD, PHASED], f"SELECT volume, phase_bin, bin_frames, coalesce(n, 0) n, u_mean, coalesce(n, 0) >= greatest(ceil(0.02 * bin_frames), 1) accepted FROM (SELECT volume, phase_bin, count(DISTINCT ti) bin_frames FROM phased GROUP BY ALL) LEFT JOIN (SELECT volume, phase_bin, count(CASE WHEN isfinite(u) THEN 1 END) n, avg(CASE WHEN isfinite(u) THEN u END) u_mean FROM phased WHERE iz = 1 AND iy = 2 AND ix = 3 GROUP BY ALL) USING (volume, phase_bin)", "volume phase_bin:i bin_frames:i n:i u_mean:d accepted")
def phase_coverage(spark, sf):
    return phase.coverage(_phased(spark, sf), BINS, 1, 2, 3, 0.02)


@query("harmonic_display_mask", PH, (
    f"SELECT volume, iz, iy, ix, component, bool_and(phase_count >= greatest(ceil(0.002 * bin_frames), 1)) AND count(*) = {BINS} shown, min(phase_count / "
    "bin_frames) least_share FROM averages GROUP BY ALL"
), "volume iz:i iy:i ix:i component shown least_share:d")
def harmonic_display_mask(spark, sf):
    return phase.all_bins(_averages(spark, sf), BINS, 0.002)


@query("phase_quality", PH, (
    "SELECT *, std / sqrt(n) standard_error FROM (SELECT p.volume, p.iz, p.iy, p.ix, p.phase_bin, count(*) n, avg(u) mean, stddev_samp(u) std, "
    "max(phase_mean - a.mean) coherent, sqrt(avg((u - phase_mean) * (u - phase_mean))) residual_rms FROM phased p JOIN averages a ON a.component = 'u' AND "
    "a.volume = p.volume AND a.iz = p.iz AND a.iy = p.iy AND a.ix = p.ix AND a.phase_bin = p.phase_bin WHERE isfinite(u) GROUP BY ALL)"
), "volume iz:i iy:i ix:i phase_bin:i n:i mean:d std:d coherent:d residual_rms:d standard_error:d")
def phase_quality(spark, sf):
    return phase.quality(_phased(spark, sf), _averages(spark, sf), BINS).filter("n > 0")


@query("phase_convergence", [FIELD, PHASED], f"""SELECT volume, phase_bin, cycle, n, mean, mean - all_mean coherent FROM (SELECT volume, phase_bin, cycle, n, s / nullif(n, 0) mean, sum(s) OVER (PARTITION BY volume, cycle) / nullif(sum(n) OVER (PARTITION BY volume, cycle), 0) all_mean FROM
 (SELECT volume, phase_bin, cycle, sum(coalesce(s, 0)) OVER w s, sum(coalesce(n, 0)) OVER w n FROM (SELECT volume, phase_bin, unnest(generate_series(c0, c1)) cycle FROM (SELECT DISTINCT volume, phase_bin FROM phased) JOIN (SELECT volume, CAST(min({CYCLE}) AS BIGINT) c0, CAST(max({CYCLE}) AS BIGINT) c1 FROM phased GROUP BY volume) USING (volume))
 LEFT JOIN (SELECT volume, phase_bin, CAST({CYCLE} AS BIGINT) cycle, sum(CASE WHEN isfinite(u) THEN u END) s, count(CASE WHEN isfinite(u) THEN 1 END) n FROM phased GROUP BY ALL) USING (volume, phase_bin, cycle) WINDOW w AS (PARTITION BY volume, phase_bin ORDER BY cycle ROWS UNBOUNDED PRECEDING)))""", "volume phase_bin:i cycle:i n:i mean:d coherent:d")
def phase_convergence(spark, sf):
    return phase.convergence(_phased(spark, sf), ["volume"], 1 / PERIOD, OFFSET)


@query("unwrapped_cycles", [SIGNAL], f"""SELECT user_id, max(floor((phase - 2 * pi() * jumps) / (2 * pi()))) turns, count(*) n FROM (SELECT *, sum(coalesce(round_even((phase - before) / (2 * pi()), 0), 0)) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) jumps
 FROM (SELECT *, lag(phase) OVER (PARTITION BY user_id ORDER BY t) before FROM (SELECT user_id, t, 2 * pi() * t / {DAY} - 2 * pi() * floor(2 * pi() * t / {DAY} / (2 * pi())) phase FROM signal))) GROUP BY user_id""", "user_id:i turns:i n:i")
def unwrapped_cycles(spark, sf):
    s = event_signal(spark, sf).withColumn("phase", F.pmod(2 * math.pi * F.col("t") / DAY, F.lit(2 * math.pi)))
    return phase.unwrapped(s, ["user_id"], order="t").groupBy("user_id").agg(F.max("cycle").alias("turns"), F.count("*").alias("n"))


# Energy


ENERGY = f"""SELECT volume, ix, n, total, locked, total - locked residual, cv_mean, cv_phase FROM
 (SELECT volume, ix, sum(q) / sum(n) / 2 - pow(sum(s) / sum(n), 2) / 2 total, CAST(sum(n) AS BIGINT) n FROM cells GROUP BY volume, ix)
 JOIN (SELECT b.volume, b.ix, sum(bn * pow(bs / bn - ks / kn, 2)) / max(kn) / 2 locked FROM by_bin b JOIN by_key k ON b.volume = k.volume AND b.ix = k.ix GROUP BY b.volume, b.ix) USING (volume, ix)
 JOIN (SELECT c.volume, c.ix, sum(q - 2 * (bs - s) / (bn - n) * s + n * pow((bs - s) / (bn - n), 2)) / sum(n) / 2 cv_phase FROM cells c JOIN by_bin b ON c.volume = b.volume AND c.ix = b.ix AND c.phase_bin = b.phase_bin GROUP BY c.volume, c.ix) USING (volume, ix)
 JOIN (SELECT c.volume, c.ix, sum(cq - 2 * (ks - cs) / (kn - cn) * cs + cn * pow((ks - cs) / (kn - cn), 2)) / sum(cn) / 2 cv_mean FROM (SELECT volume, ix, cycle, sum(n) cn, sum(s) cs, sum(q) cq FROM cells GROUP BY ALL) c JOIN by_key k ON c.volume = k.volume AND c.ix = k.ix GROUP BY c.volume, c.ix) USING (volume, ix)"""
EN = [FIELD, PHASED, f"cells AS (SELECT volume, ix, phase_bin, {CYCLE} AS cycle, count(*) n, sum(v) s, sum(v * v) q FROM phased GROUP BY ALL)", "by_bin AS (SELECT volume, ix, phase_bin, sum(n) bn, sum(s) bs FROM cells GROUP BY ALL)", "by_key AS (SELECT volume, ix, sum(n) kn, sum(s) ks FROM cells GROUP BY ALL)"]


@query("energy_budget", EN, ENERGY, "volume ix:i n:i total:d locked:d residual:d cv_mean:d cv_phase:d")
def energy_budget(spark, sf):
    return energy.budget(_phased(spark, sf), ["volume", "ix"], "v", BINS, 1 / PERIOD, OFFSET).select("volume", "ix", "n", "total", "locked", "residual", "cv_mean", "cv_phase")


@query("energy_reduction", [FIELD, VOX], (
    "SELECT volume, CASE WHEN count(*) = count(tke) THEN sum(tke * (ix + 1)) / sum(ix + 1) END tke, sum(w_mean * (ix + 1)) / sum(ix + 1) w_mean FROM vox "
    "GROUP BY volume"
), "volume tke:d w_mean:d")
def energy_reduction(spark, sf):
    f = lineitem_field(spark, sf)
    mean = stats.temporal_mean(f)
    both = mean.join(stats.kinetic_energy(f, mean), VOXEL).withColumn("weight", F.col("ix") + 1)
    return stats.weighted(both, ["tke", "w_mean"], "weight", ["volume"])


@query("slab_overlap", M, (
    "SELECT volume, slab, sum(w * u_mean) / sum(w) u, sum(w) weight FROM (SELECT volume, u_mean, slab, greatest(least(ix + 0.5, hi) - greatest(ix - 0.5, "
    "lo), 0) w FROM mean CROSS JOIN (VALUES ('near', 0.5, 2.75), ('far', 2.75, 9.0)) s(slab, lo, hi) WHERE u_mean IS NOT NULL AND ix + 0.5 > lo AND ix - "
    "0.5 < hi) GROUP BY ALL"
), "volume slab u:d weight:d")
def slab_overlap(spark, sf):
    cells = _mean(spark, sf).filter(finite(F.col("u_mean"))).select("volume", "u_mean", (F.col("ix") - 0.5).alias("low"), (F.col("ix") + 0.5).alias("high"))
    slabs = spark.createDataFrame([("near", 0.5, 2.75), ("far", 2.75, 9.0)], "slab string, from_ double, to double")
    return energy.slab_weights(cells, slabs).groupBy("volume", "slab").agg((F.sum(F.col("weight") * F.col("u_mean")) / F.sum("weight")).alias("u"), F.sum("weight").alias("weight"))


# Gaps and grids


GAP = """SELECT series, id, coalesce(value, CASE WHEN l IS NOT NULL AND r IS NOT NULL AND i - li <= 2 AND ri - i <= 2 THEN l + (t - lt) / (rt - lt) * (r - l) END) AS value, value IS NULL AND l IS NOT NULL AND r IS NOT NULL AND i - li <= 2 AND ri - i <= 2 AS value_filled FROM
 (SELECT *, last_value(value IGNORE NULLS) OVER b l, last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER b lt, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b li,
 first_value(value IGNORE NULLS) OVER a r, first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER a rt, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER a ri FROM ordered
 WINDOW b AS (PARTITION BY series, user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY series, user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""
ORDERED = "ordered AS (SELECT *, row_number() OVER (PARTITION BY series, user_id ORDER BY t, id) - 1 AS i FROM signal)"


def _ordered(spark: SparkSession, sf: str) -> DataFrame:
    return event_signal(spark, sf).withColumn("i", F.row_number().over(Window.partitionBy("series", "user_id").orderBy("t", "id")) - 1)


@query("gap_interpolation", [SIGNAL, ORDERED], GAP, "series id:i value:d value_filled")
def gap_interpolation(spark, sf):
    return fill.interpolate_line(_ordered(spark, sf), ["series", "user_id"], "i", "t", "value", side_gap=2).select("series", "id", "value", "value_filled")


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    """One sample for each voxel and month: a regular grid with holes."""
    f = lineitem_field(spark, sf).withColumn("ti", F.floor(F.col("ti") / 30).cast("int"))
    ok = finite(F.col("u")) & (F.col("row") % 3 == 0)
    return f.groupBy("volume", "ti", "iz", "iy", "ix").agg(F.col("ti").cast("double").alias("t"), F.avg(F.when(ok, F.col("u"))).alias("u"), F.avg("v").alias("v"), F.avg("w").alias("w"))


@query("align_planes", [FIELD], """SELECT volume, ti, iy, ix, k idx, CASE WHEN count(v) = 2 AND count(*) = 2 THEN sum(v * w) END v FROM (SELECT g.*, s.k, CASE WHEN g.iz = s.lo THEN 1 - s.wt ELSE s.wt END w FROM (SELECT volume, floor(ti / 30) ti, iz, iy, ix, avg(field.v) v FROM field GROUP BY ALL) g JOIN (VALUES (0, 0, 1, 0.5), (1, 2, 3, 0.25)) s(k, lo, hi, wt) ON g.iz = s.lo OR g.iz = s.hi) GROUP BY volume, ti, iy, ix, k""", "volume ti:i iy:i ix:i idx:i v:d")
def align_planes(spark, sf):
    g = _grid(spark, sf).withColumn("z", F.col("iz").cast("double"))
    targets = g.select("volume").distinct().crossJoin(spark.createDataFrame([(0, 0.5), (1, 2.25)], "idx int, z double"))
    return regrid.align_axis(g, "z", "z", targets, ("v",)).select("volume", "ti", "iy", "ix", F.col("iz").alias("idx"), "v")


@query("trilinear_points", M, """SELECT volume, target, sum(wt * v_mean) v_mean FROM (SELECT volume, v_mean, target, (1 - abs(iz - z)) * (1 - abs(iy - y)) * (1 - abs(ix - x)) wt FROM mean CROSS JOIN (VALUES (0, 0.5, 1.25, 2.5), (1, 2.0, 3.5, 4.75)) p(target, z, y, x) WHERE abs(iz - z) < 1 AND abs(iy - y) < 1 AND abs(ix - x) < 1) GROUP BY ALL""", "volume target:i v_mean:d")
def trilinear_points(spark, sf):
    mean = _mean(spark, sf)
    axes = fields.axes_of(mean, z="iz", y="iy", x="ix")
    targets = mean.select("volume").distinct().crossJoin(spark.createDataFrame([(0, 0.5, 1.25, 2.5), (1, 2.0, 3.5, 4.75), (2, 9.0, 1.0, 1.0)], "target int, z double, y double, x double"))
    return regrid.trilinear(mean, axes, targets, ["v_mean"])


@query("common_support", M, (
    "SELECT iz, iy, ix, bool_and(u_count >= ceil(0.05 * n_times) AND u_count >= 2) AND count(DISTINCT volume) = (SELECT count(DISTINCT volume) FROM mean) "
    "support, min(u_count / n_times) availability FROM mean GROUP BY ALL"
), "iz:i iy:i ix:i support availability:d")
def common_support(spark, sf):
    counts = _mean(spark, sf).select("volume", "iz", "iy", "ix", F.col("u_count").alias("n"), "n_times")
    return regrid.common_support(counts, ["iz", "iy", "ix"], "volume", 0.05)


@query("blended_volumes", M, "SELECT iz, iy, ix, avg(u_mean) u_mean, count(u_mean) contributors FROM mean GROUP BY ALL HAVING count(u_mean) > 0", "iz:i iy:i ix:i u_mean:d contributors:i")
def blended_volumes(spark, sf):
    return regrid.blend(_mean(spark, sf), ["iz", "iy", "ix"], "u_mean")


@query("overlap_diagnostics", M, (
    "SELECT a.volume AS \"first\", b.volume AS \"second\", count(*) n, sqrt(avg(pow(a.v_mean - b.v_mean, 2) + pow(a.w_mean - b.w_mean, 2))) rms, "
    "sqrt(pow(sum(a.v_mean * b.v_mean + a.w_mean * b.w_mean), 2) + pow(sum(a.w_mean * b.v_mean - a.v_mean * b.w_mean), 2)) / sqrt(sum(a.v_mean * a.v_mean "
    "+ a.w_mean * a.w_mean) * sum(b.v_mean * b.v_mean + b.w_mean * b.w_mean)) correlation, degrees(atan2(sum(a.w_mean * b.v_mean - a.v_mean * b.w_mean), "
    "sum(a.v_mean * b.v_mean + a.w_mean * b.w_mean))) phase_difference FROM mean a JOIN mean b ON a.iz = b.iz AND a.iy = b.iy AND a.ix = b.ix AND a.volume "
    "< b.volume GROUP BY ALL"
), '"first" "second" n:i rms:d correlation:d phase_difference:d')
def overlap_diagnostics(spark, sf):
    return regrid.overlap_diagnostics(_mean(spark, sf), ["iz", "iy", "ix"], "v_mean", "w_mean")


@query("cell_widths", [FIELD], (
    "SELECT volume, idx, CASE WHEN b IS NULL OR a IS NULL THEN coalesce(a, b) / 2 ELSE (a + b) / 2 END width FROM (SELECT volume, ix idx, coord - "
    "lag(coord) OVER w b, lead(coord) OVER w - coord a FROM (SELECT DISTINCT volume, ix, CAST(ix * ix AS DOUBLE) coord FROM field) WINDOW w AS (PARTITION "
    "BY volume ORDER BY ix))"
), "volume idx:i width:d")
def cell_widths(spark, sf):
    axes = fields.axes_of(lineitem_field(spark, sf).withColumn("x2", F.col("ix") * F.col("ix")), x="x2")
    return regrid.centre_widths(axes).select("volume", "idx", "width")


# Correlation and decomposition


PAIRS = """pairs AS (SELECT a.series, b.i - a.i lag, count(*) n, sum(a.value * b.value) ab, sum(a.value * a.value) aa, sum(b.value * b.value) bb FROM centred a JOIN centred b ON a.series = b.series AND a.user_id = b.user_id AND b.i BETWEEN a.i AND a.i + 5 GROUP BY ALL)"""
CENTRED = "centred AS (SELECT series, user_id, i, value - avg(value) OVER (PARTITION BY series) AS value FROM ordered WHERE value IS NOT NULL)"
CO = [SIGNAL, ORDERED, CENTRED, PAIRS]


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    s = _ordered(spark, sf).withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("series")))
    return correlation.pair_moments(s, ["series", "user_id"], "i", "value", 5, ["series"])


@query("pair_correlation", CO, "SELECT series, lag, n, CASE WHEN n >= 10 AND aa * bb > 0 THEN least(greatest(ab / sqrt(aa * bb), -1), 1) END rho FROM pairs", "series lag:i n:i rho:d")
def pair_correlation(spark, sf):
    return correlation.normalised(_pairs(spark, sf), ["series"], 10)


@query("integral_scale", CO, """SELECT series, min(CASE WHEN rho > 0 AND nxt <= 0 THEN lag + rho / (rho - nxt) END) AS zero FROM (SELECT series, lag, rho, lead(rho) OVER (PARTITION BY series ORDER BY lag) nxt FROM (SELECT series, lag, ab / sqrt(aa * bb) rho FROM pairs)) GROUP BY series""", "series zero:d")
def integral_scale(spark, sf):
    return correlation.integral_scale(correlation.normalised(_pairs(spark, sf), ["series"]), ["series"]).select("series", "zero")


CENTERED = "flu AS (SELECT snapshot, dof, value - avg(value) OVER (PARTITION BY dof) AS x FROM snaps)"


@query("snapshot_gram", [SNAP, CENTERED], "SELECT a.dof i, b.dof j, sum(a.x * b.x) g FROM flu a JOIN flu b ON a.snapshot = b.snapshot AND a.dof <= b.dof GROUP BY ALL", "i:i j:i g:d")
def snapshot_gram(spark, sf):
    return pod.gram(pod.fluctuations(snapshots(spark, sf)), "dof", "snapshot")


@query("pod_energy", [SNAP, CENTERED], "SELECT sum(x * x) / count(DISTINCT snapshot) / 2 energy, count(DISTINCT dof) modes, sum(x * x) / sum(x * x) fraction FROM flu", "energy:d modes:i fraction:d")
def pod_energy(spark, sf):
    spectrum, _, _ = pod.decompose(snapshots(spark, sf), 64)
    return spectrum.agg(F.sum("energy").alias("energy"), F.count("*").alias("modes"), F.sum("fraction").alias("fraction"))


@query("pod_reconstruction", [SNAP, CENTERED], "SELECT snapshot, sum(x * x) energy FROM flu GROUP BY snapshot", "snapshot:i energy:d")
def pod_reconstruction(spark, sf):
    _, modes, a = pod.decompose(snapshots(spark, sf), 64)
    return pod.reconstruct(modes, a).groupBy("snapshot").agg(F.sum(F.col("x") * F.col("x")).alias("energy"))


# Spectra


HOURS = "hours AS (SELECT series, floor(t / 3600) AS h, avg(value) AS x FROM signal WHERE value IS NOT NULL GROUP BY ALL)"
HX = "hx AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY h) - 1 AS i, x - avg(x) OVER (PARTITION BY series) AS x, count(*) OVER (PARTITION BY series) AS n FROM hours)"
PSD = (
    "psd AS (SELECT series, k, k / CAST(n AS DOUBLE) AS frequency, CASE WHEN k = 0 OR 2 * k = n THEN 1.0 ELSE 2.0 END * (pow(sum(x * cos(2 * pi() * ((k * "
    "i) % n) / n)), 2) + pow(sum(x * sin(2 * pi() * ((k * i) % n) / n)), 2)) / n AS psd FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM hx) GROUP "
    "BY series, k, n)"
)
SP = [SIGNAL, HOURS, HX, PSD]


def _hours(spark: SparkSession, sf: str) -> DataFrame:
    h = event_signal(spark, sf).filter("value is not null").groupBy("series", F.floor(F.col("t") / 3600).alias("h")).agg(F.avg("value").alias("x"))
    return h.withColumn("i", F.row_number().over(Window.partitionBy("series").orderBy("h")) - 1)


def _psd(spark: SparkSession, sf: str) -> DataFrame:
    return spectra.periodogram(_hours(spark, sf), ["series"], "i", "x", 1.0)


@query("periodogram", SP, "SELECT * FROM psd", "series k:i frequency:d psd:d")
def periodogram(spark, sf):
    return _psd(spark, sf)


@query("spectral_peak", SP, "SELECT series, arg_max(frequency, psd) peak, max(psd) psd FROM psd WHERE k > 0 GROUP BY series", "series peak:d psd:d")
def spectral_peak(spark, sf):
    return spectra.peak(_psd(spark, sf), ["series"])


@query("band_energy", SP, (
    "SELECT series, sum(CASE WHEN frequency BETWEEN 0.02 AND 0.1 THEN psd END) * max(frequency / nullif(k, 0)) band_energy, sum(CASE WHEN frequency "
    "BETWEEN 0.02 AND 0.1 THEN psd END) / sum(psd) band_fraction, max(CASE WHEN frequency BETWEEN 0.02 AND 0.1 THEN frequency END) last_frequency FROM psd "
    "WHERE k > 0 GROUP BY series"
), "series band_energy:d band_fraction:d last_frequency:d")
def band_energy(spark, sf):
    return spectra.band_energy(_psd(spark, sf), ["series"], 0.02, 0.1)


@query("band_table", SP, (
    "SELECT series, band, sum(psd * frequency / k) energy, count(*) n_bins, sum(psd * frequency / k) / max(whole) fraction FROM (SELECT *, sum(psd * "
    "frequency / k) OVER (PARTITION BY series) whole FROM psd WHERE k > 0) JOIN (VALUES ('daily', 0.03, 0.06), ('half', 0.07, 0.09)) b(band, low, high) ON "
    "frequency BETWEEN low AND high GROUP BY ALL"
), "series band energy:d n_bins:i fraction:d")
def band_table(spark, sf):
    bands = spark.createDataFrame([("daily", 0.03, 0.06), ("half", 0.07, 0.09)], "band string, low double, high double")
    return spectra.band_table(_psd(spark, sf), ["series"], bands)


@query("welch_spectrum", [SIGNAL, HOURS, "hi AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY h) - 1 AS i, x, count(*) OVER (PARTITION BY series) AS n FROM hours)", (
    "seg AS (SELECT series, s, i - 16 * s AS j, x - avg(x) OVER (PARTITION BY series, s) AS x FROM hi JOIN (SELECT unnest(range(0, 100000)) s) ON i "
    "BETWEEN 16 * s AND 16 * s + 31 AND 16 * s + 32 <= n)"
)],
 (
     "SELECT series, k, k / 32.0 frequency, avg(p) psd, count(*) n_segments FROM (SELECT series, s, k, CASE WHEN k IN (0, 16) THEN 1.0 ELSE 2.0 END * "
     "(pow(sum(x * wt * cos(2 * pi() * ((k * j) % 32) / 32)), 2) + pow(sum(x * wt * sin(2 * pi() * ((k * j) % 32) / 32)), 2)) / sum(wt * wt) p FROM (SELECT "
     "*, 0.5 - 0.5 * cos(2 * pi() * j / 32) wt, unnest(range(0, 17)) k FROM seg) GROUP BY series, s, k) GROUP BY ALL"
 ), "series k:i frequency:d psd:d n_segments:i")
def welch_spectrum(spark, sf):
    return spectra.welch(_hours(spark, sf), ["series"], "i", "x", 1.0, 32)


# Wake geometry


DEF = f"wake AS (SELECT *, ({U_INF} - u_mean) / {U_INF} AS deficit, iy - 2.0 AS y, iz - 1.5 AS z FROM mean)"
W_ = [*M, DEF]


def _wake(spark: SparkSession, sf: str) -> DataFrame:
    m = stats.wake_ratios(_mean(spark, sf), U_INF).withColumnRenamed("wake_deficit", "deficit")
    return m.withColumns({"y": F.col("iy") - 2.0, "z": F.col("iz") - 1.5})


@query("radial_average", W_, (
    "SELECT volume, ix, CAST(floor(sqrt(y * y + z * z) / 0.5) AS INTEGER) ring, avg(deficit) mean, count(deficit) n FROM wake WHERE floor(sqrt(y * y + z * "
    "z) / 0.5) < (SELECT ceil((max(sqrt(y * y + z * z)) + 0.5) / 0.5) - 1 FROM wake) GROUP BY ALL"
), "volume ix:i ring:i mean:d n:i")
def radial_average(spark, sf):
    return wake.radial_average(_wake(spark, sf).withColumn("r", F.sqrt(F.col("y") * F.col("y") + F.col("z") * F.col("z"))), ["volume", "ix"], "r", "deficit", 0.5)


@query("integrated_deficit", W_, "SELECT volume, avg(deficit) mean, count(deficit) n FROM wake WHERE ix = 3 AND y * y + z * z <= 4 GROUP BY volume", "volume mean:d n:i")
def integrated_deficit(spark, sf):
    return wake.integrated(wake.nearest_plane(_wake(spark, sf), "ix", 3.2), ["volume"], "deficit", wake.disc(F.col("y"), F.col("z"), 2.0))


@query("deficit_by_slice", W_, (
    "SELECT volume, ix, n, CASE WHEN n >= ceil(0.9 * max(n) OVER (PARTITION BY volume)) THEN mean END mean FROM (SELECT volume, ix, avg(deficit) mean, "
    "count(deficit) n FROM wake GROUP BY ALL) QUALIFY ix > min(ix) OVER (PARTITION BY volume) AND ix < max(ix) OVER (PARTITION BY volume)"
), "volume ix:i n:i mean:d")
def deficit_by_slice(spark, sf):
    return wake.integrated_by_slice(_wake(spark, sf), "deficit", 0.9, 1)


@query("slab_velocity", M, (
    "SELECT volume, ix, avg(CASE WHEN u_count / n_times > 0.03 THEN u_mean END) u_mean, count(CASE WHEN u_count / n_times > 0.03 THEN u_mean END) n FROM "
    "mean GROUP BY ALL"
), "volume ix:i u_mean:d n:i")
def slab_velocity(spark, sf):
    return wake.slab_mean(_mean(spark, sf), 0.03)


@query("wake_centre", W_, (
    "SELECT volume, ix, sum(CASE WHEN deficit > 0 THEN deficit * 0.25 * y END) / sum(CASE WHEN deficit > 0 THEN deficit * 0.25 END) y, sum(CASE WHEN "
    "deficit > 0 THEN deficit * 0.25 * z END) / sum(CASE WHEN deficit > 0 THEN deficit * 0.25 END) z, sum(CASE WHEN deficit > 0 THEN deficit * 0.25 END) "
    "strength FROM wake GROUP BY ALL"
), "volume ix:i y:d z:d strength:d")
def wake_centre(spark, sf):
    return wake.centre(_wake(spark, sf), ["volume", "ix"], "deficit", F.lit(0.25))


@query("fixed_support", PH, f"""SELECT volume, ix, phase_bin, sum(d * (iy + 1)) / sum(iy + 1) mean_deficit, sum(CASE WHEN d > 0 THEN d * (iy + 1) * y END) / sum(CASE WHEN d > 0 THEN d * (iy + 1) END) y, max(cov) coverage FROM
 (SELECT *, ({U_INF} - phase_mean) / {U_INF} d, iy - 2.0 y, count(phase_mean) OVER (PARTITION BY volume, ix, iz, iy) = {BINS} held FROM averages WHERE component = 'u')
 JOIN (SELECT volume, ix, sum(CASE WHEN held THEN iy + 1 END) / sum(iy + 1) cov FROM (SELECT volume, ix, iz, iy, count(phase_mean) = {BINS} held FROM averages WHERE component = 'u' GROUP BY ALL) GROUP BY ALL) USING (volume, ix) WHERE held GROUP BY ALL""", "volume ix:i phase_bin:i mean_deficit:d y:d coverage:d")
def fixed_support(spark, sf):
    a = _averages(spark, sf).filter("component = 'u'")
    cells = a.select("volume", "ix", "iz", "iy", "phase_bin", ((U_INF - F.col("phase_mean")) / U_INF).alias("deficit"), (F.col("iy") + 1.0).alias("area"), (F.col("iy") - 2.0).alias("y"), (F.col("iz") - 1.5).alias("z"))
    return wake.fixed_support(cells, ["volume", "ix"], ["iz", "iy"], "phase_bin", "deficit", "area", BINS).select("volume", "ix", "phase_bin", "mean_deficit", "y", "coverage")


@query("sector_area", W_, """SELECT volume, ix, sum(area) area FROM (SELECT volume, iy, iz, ix, count(*) / 256.0 area FROM wake CROSS JOIN (SELECT unnest(range(0, 16)) i) CROSS JOIN (SELECT unnest(range(0, 16)) j) WHERE pow(y + (i + 0.5) / 16 - 0.5, 2) + pow(z + (j + 0.5) / 16 - 0.5, 2) <= 2.25
 AND degrees(atan2(z + (j + 0.5) / 16 - 0.5, y + (i + 0.5) / 16 - 0.5)) + 30 - 360 * floor((degrees(atan2(z + (j + 0.5) / 16 - 0.5, y + (i + 0.5) / 16 - 0.5)) + 30) / 360) <= 100 GROUP BY ALL) GROUP BY volume, ix""", "volume ix:i area:d")
def sector_area(spark, sf):
    return _wake(spark, sf).groupBy("volume", "ix").agg(F.sum(wake.sector_share(F.col("y"), F.col("z"), F.lit(1.0), F.lit(1.0), 1.5, -30.0, 100.0)).alias("area"))


@query("outside_earlier", [*M, "placed AS (SELECT volume, o, ix + 4 * o x FROM (SELECT volume, ix, CASE volume WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END o FROM mean))", "reached AS (SELECT o, min(x) lo, max(x) hi FROM placed GROUP BY o)"],
 "SELECT volume, count(*) n FROM placed p WHERE NOT EXISTS (SELECT 1 FROM reached r WHERE r.o < p.o AND p.x BETWEEN r.lo AND r.hi) GROUP BY volume", "volume n:i")
def outside_earlier(spark, sf):
    order = F.when(F.col("volume") == "A", 0).when(F.col("volume") == "N", 1).otherwise(2)
    cells = _mean(spark, sf).withColumn("order", order).withColumn("x", F.col("ix") + 4 * F.col("order"))
    return wake.outside_earlier(cells, "order").groupBy("volume").agg(F.count("*").alias("n"))


@query("straight_line", M, (
    "SELECT volume, volume IS NULL pooled, count(*) n, regr_slope(v_mean, ix) slope, regr_intercept(v_mean, ix) intercept, regr_r2(v_mean, ix) r2, "
    "sqrt((regr_syy(v_mean, ix) - regr_slope(v_mean, ix) * regr_sxy(v_mean, ix)) / count(*)) rmse FROM mean GROUP BY GROUPING SETS ((volume), ())"
), "volume pooled n:i slope:d intercept:d r2:d rmse:d")
def straight_line(spark, sf):
    return wake.straight_line(_mean(spark, sf), ["volume"], "ix", "v_mean")


# Vortices


SW = f"swirl AS (SELECT *, CASE WHEN u_mean IS NOT NULL THEN -(v_mean - 38) * (u_mean - 25) * 4 / ({U_INF} * {U_INF}) END AS s FROM mean)"
SG = (
    "signed AS (SELECT volume, iz, iy, ix, greatest(CASE WHEN top <= 0 AND low < 0 THEN -s ELSE s END, 0) AS s FROM swirl JOIN (SELECT volume, max(s) top, "
    "min(s) low FROM swirl GROUP BY volume) USING (volume))"
)
V_ = [*M, SW, SG]


def _swirl(spark: SparkSession, sf: str) -> DataFrame:
    raw = -(F.col("v_mean") - 38) * (F.col("u_mean") - 25)
    m = _mean(spark, sf).withColumn("s", vortex.nondimensional(vortex.hole_mask(raw, [F.col("u_mean")], "velocity-nan"), 2.0, U_INF))
    return vortex.signed(m, "s", ["volume"]).select(*VOXEL, "s")


@query("signed_swirl", V_, "SELECT * FROM signed", "volume iz:i iy:i ix:i s:d")
def signed_swirl(spark, sf):
    return _swirl(spark, sf)


@query("swirl_thresholds", V_, " UNION ALL ".join(f"SELECT volume, 'max_{round(100 * s)}' kind, max(s) * {s} level FROM signed WHERE s > 0 GROUP BY volume" for s in vortex.SHARES) + " UNION ALL " + " UNION ALL ".join(f"SELECT volume, 'p{p * 100:g}' kind, quantile_cont(s, {p}) level FROM signed WHERE s > 0 GROUP BY volume" for p in vortex.PERCENTILES), "volume kind level:d")
def swirl_thresholds(spark, sf):
    return vortex.thresholds(_swirl(spark, sf), ["volume"], "s")


def _active(spark: SparkSession, sf: str, quantile: float = 0.7) -> DataFrame:
    s = _swirl(spark, sf)
    level = quantiles(s.filter("s > 0"), ["volume"], "s", [quantile]).select("volume", F.get("q", F.lit(0)).alias("level"))
    return s.join(level, "volume").filter(F.col("s") >= F.col("level"))


ACT = (
    "act AS (SELECT volume, iz, iy, ix, s, (ix * 100 + iy) * 100 + iz AS c FROM signed JOIN (SELECT volume, quantile_cont(s, 0.7) level FROM signed WHERE "
    "s > 0 GROUP BY volume) USING (volume) WHERE s >= level)"
)
REACH = (
    "reach AS (SELECT volume, c, c AS r FROM act UNION SELECT b.volume, b.c, p.r FROM reach p JOIN act a ON a.volume = p.volume AND a.c = p.c JOIN act b "
    "ON b.volume = a.volume AND abs(a.ix - b.ix) + abs(a.iy - b.iy) + abs(a.iz - b.iz) = 1)"
)
COMP = (
    "SELECT volume, size, ix_centre, iy_centre, iz_centre, peak, integral FROM (SELECT volume, root, count(*) size, avg(ix) ix_centre, avg(iy) iy_centre, "
    "avg(iz) iz_centre, max(s) peak, sum(s) integral FROM act JOIN (SELECT volume, c, min(r) root FROM reach GROUP BY ALL) USING (volume, c) GROUP BY ALL) "
    "WHERE size >= 2"
)


@query("components_3d", ["RECURSIVE " + FIELD, TIMES, MEAN, SW, SG, ACT, REACH], COMP, "volume size:i ix_centre:d iy_centre:d iz_centre:d peak:d integral:d")
def components_3d(spark, sf):
    found = vortex.component_stats(vortex.label(_active(spark, sf), ["volume"]), ["volume"], "s", min_size=2)
    return found.select("volume", "size", "ix_centre", "iy_centre", "iz_centre", "peak", "integral")


@query("components_2d", ["RECURSIVE " + FIELD, TIMES, MEAN, SW, SG, ACT.replace("act AS", "act0 AS"), "act AS (SELECT * FROM act0)", (
    "reach AS (SELECT volume, iz, c, c AS r FROM act UNION SELECT b.volume, b.iz, b.c, p.r FROM reach p JOIN act a ON a.volume = p.volume AND a.c = p.c "
    "JOIN act b ON b.volume = a.volume AND a.iz = b.iz AND abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1)"
)], (
    "SELECT volume, iz, count(*) size, max(s) peak FROM act JOIN (SELECT volume, c, min(r) root FROM reach GROUP BY ALL) USING (volume, c) GROUP BY "
    "volume, iz, root"
), "volume iz:i size:i peak:d")
def components_2d(spark, sf):
    found = vortex.component_stats(vortex.label(_active(spark, sf), ["volume", "iz"], ("iy", "ix")), ["volume", "iz"], "s", ("iy", "ix"))
    return found.select("volume", "iz", "size", "peak")


@query("grid_inspection", [FIELD, (
    "grids AS (SELECT volume, count(DISTINCT ix) nx, count(DISTINCT iy) ny, count(DISTINCT iz) nz, sum(n) n, sum(n) - count(*) repeated, count(DISTINCT "
    "ix) * count(DISTINCT iy) * count(DISTINCT iz) - count(*) missing, 100.0 * sum(bad) / sum(n) bad_percent FROM (SELECT volume, ix, iy, iz, count(*) n, "
    "count(CASE WHEN NOT isfinite(u) THEN 1 END) bad FROM field GROUP BY ALL) GROUP BY volume)"
), (
    "scored AS (SELECT *, missing = 0 AND repeated = 0 structured, CASE WHEN least(nx, ny, nz) < 3 THEN 3 ELSE 0 END + CASE WHEN missing = 0 AND repeated "
    "= 0 THEN 0 ELSE 2 END + CASE WHEN bad_percent > 20 THEN 2 WHEN bad_percent > 5 THEN 1 ELSE 0 END score FROM grids)"
)],
 "SELECT *, CASE WHEN score >= 5 THEN 'too coarse' WHEN score >= 2 THEN 'qualitative' ELSE 'suitable' END verdict FROM scored", "volume nx:i ny:i nz:i n:i repeated:i missing:i bad_percent:d structured score:i verdict")
def grid_inspection(spark, sf):
    f = lineitem_field(spark, sf).withColumns({a: F.col(f"i{a}") for a in "xyz"})
    return vortex.suitability(vortex.inspect_grid(f, ["volume"], "u"))


@query("structured_indices", M, (
    "SELECT volume, dense_rank() OVER (PARTITION BY volume ORDER BY ix) - 1 kx, dense_rank() OVER (PARTITION BY volume ORDER BY iy) - 1 ky, dense_rank() "
    "OVER (PARTITION BY volume ORDER BY iz) - 1 kz, v_mean FROM mean"
), "volume kx:i ky:i kz:i v_mean:d")
def structured_indices(spark, sf):
    m = _mean(spark, sf).select("volume", F.col("ix").alias("x"), F.col("iy").alias("y"), F.col("iz").alias("z"), "v_mean")
    return vortex.grid_indices(m, ["volume"]).select("volume", F.col("ix").alias("kx"), F.col("iy").alias("ky"), F.col("iz").alias("kz"), "v_mean")


@query("axis_projection", V_, (
    "SELECT volume, ix, iz, max(s) most, coalesce(sum(tr), 0) integral FROM (SELECT *, (s + lag(s) OVER w) / 2 * (iy - lag(iy) OVER w) tr FROM signed "
    "WHERE s IS NOT NULL WINDOW w AS (PARTITION BY volume, ix, iz ORDER BY iy)) GROUP BY ALL"
), "volume ix:i iz:i most:d integral:d")
def axis_projection(spark, sf):
    return vortex.projection(_swirl(spark, sf), ["volume", "ix", "iz"], "iy", "s")


@query("isosurface_points", V_, (
    "SELECT volume, iz, iy, ix, s, level FROM signed CROSS JOIN (SELECT quantile_cont(s, 0.9) level, max(s) top FROM signed WHERE s > 0) WHERE level > 0 "
    "AND level < top AND s >= level"
), "volume iz:i iy:i ix:i s:d level:d")
def isosurface_points(spark, sf):
    return vortex.exceedance(_swirl(spark, sf), "s", 0.9)


# Probes and comparisons


@query("probe_runs", [SIGNAL], """SELECT series, user_id, run, count(*) n FROM (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY series, user_id ORDER BY p) run FROM (SELECT *, coalesce(p - lag(p) OVER w <> 1 OR height <> lag(height) OVER w, false) brk FROM (SELECT *, row_number() OVER (PARTITION BY series, user_id ORDER BY t, id) p, CAST(floor(t / 86400 / 10) AS BIGINT) height FROM signal) WHERE value IS NOT NULL WINDOW w AS (PARTITION BY series, user_id ORDER BY p))) GROUP BY ALL""", "series user_id:i run:i n:i")
def probe_runs(spark, sf):
    s = _ordered(spark, sf).withColumn("height", F.floor(F.col("t") / DAY / 10))
    return probe.runs(s, ["series", "user_id"], "i", "height", "value").groupBy("series", "user_id", "run").agg(F.count("*").alias("n"))


HEIGHT = "heights AS (SELECT series, CAST(floor(t / 86400 / 5) AS BIGINT) AS height, value FROM signal)"


def _heights(spark: SparkSession, sf: str) -> DataFrame:
    return event_signal(spark, sf).withColumn("height", F.floor(F.col("t") / DAY / 5))


@query("probe_profile", [SIGNAL, HEIGHT], (
    "SELECT series, height, count(value) n, avg(value) mean, stddev_samp(value) std, 100 * stddev_samp(value) / nullif(abs(avg(value)), 0) intensity, "
    "avg(value) / 10 mean_ref FROM heights GROUP BY ALL"
), "series height:i n:i mean:d std:d intensity:d mean_ref:d")
def probe_profile(spark, sf):
    return probe.profile(_heights(spark, sf), ["series", "height"], "value", 10.0).drop("std_ref")


@query("shared_densities", [SIGNAL], (
    "SELECT series, bin, count(*) n, any_value(lo) + bin * any_value(w) from_, count(*) / (sum(count(*)) OVER (PARTITION BY series) * any_value(w)) "
    "density FROM (SELECT series, least(CAST(floor((value - lo) / w) AS INTEGER), 19) bin, lo, w FROM signal CROSS JOIN (SELECT min(value) lo, (max(value) "
    "- min(value)) / 20 w FROM signal) WHERE value IS NOT NULL) GROUP BY series, bin"
), "series bin:i n:i from_:d density:d")
def shared_densities(spark, sf):
    return probe.densities(event_signal(spark, sf), ["series"], "value", 20)


@query("matched_heights", [SIGNAL, HEIGHT, "profiles AS (SELECT series, height, avg(value) m FROM heights GROUP BY ALL)"], (
    "SELECT a.series first_series, b.series second_series, a.height, a.m mean_a, b.m mean_b, b.m - a.m mean_difference, 100 * (b.m - a.m) / abs(a.m) "
    "mean_percent FROM profiles a JOIN profiles b ON a.series < b.series AND a.height = b.height"
), "first_series second_series height:i mean_a:d mean_b:d mean_difference:d mean_percent:d")
def matched_heights(spark, sf):
    return probe.all_paired(probe.profile(_heights(spark, sf), ["series", "height"], "value"), "series", ["height"], ["mean"])


@query("baseline_ratios", W_, (
    "SELECT r.volume, r.ix, r.d, r.d / b.d \"A_ratio\", r.d - b.d \"A_difference\", 100 * (r.d - b.d) / b.d \"A_percent\" FROM (SELECT volume, ix, "
    "avg(deficit) d FROM wake GROUP BY ALL) r LEFT JOIN (SELECT ix, avg(deficit) d FROM wake WHERE volume = 'A' GROUP BY ix) b ON r.ix = b.ix"
), 'volume ix:i d:d "A_ratio":d "A_difference":d "A_percent":d')
def baseline_ratios(spark, sf):
    rows = _wake(spark, sf).groupBy("volume", "ix").agg(F.avg("deficit").alias("d"))
    return compare.to_baselines(rows, "volume", ["ix"], "d", ("A",))


@query("missing_combinations", [FIELD], (
    "SELECT volume, day FROM (SELECT DISTINCT volume FROM field) CROSS JOIN (SELECT DISTINCT CAST(ti AS BIGINT)  AS day FROM field) EXCEPT SELECT volume, "
    "ti FROM field"
), "volume day:i")
def missing_combinations(spark, sf):
    f = lineitem_field(spark, sf).select("volume", F.col("ti").cast("long").alias("day"))
    return compare.missing_combinations(f, "volume", "day")


SUP = "sup AS (SELECT volume, iz, iy, ix FROM mean WHERE u_count >= ceil(0.05 * n_times))"


@query("unequal_supports", [*M, SUP], """SELECT a || '-' || b pair, iz, iy, ix, only_in FROM (SELECT p.volume a, q.volume b, s.iz, s.iy, s.ix, CASE WHEN s.volume = p.volume THEN 'a' ELSE 'b' END only_in, CASE WHEN s.volume = p.volume THEN q.volume ELSE p.volume END other
 FROM (SELECT DISTINCT volume FROM sup) p JOIN (SELECT DISTINCT volume FROM sup) q ON p.volume < q.volume JOIN sup s ON s.volume IN (p.volume, q.volume)) x WHERE NOT EXISTS (SELECT 1 FROM sup t WHERE t.volume = x.other AND t.iz = x.iz AND t.iy = x.iy AND t.ix = x.ix)""", "pair iz:i iy:i ix:i only_in")
def unequal_supports(spark, sf):
    s = cut(_mean(spark, sf).filter(F.col("u_count") >= F.ceil(0.05 * F.col("n_times"))).select(*VOXEL))
    names = s.select(F.col("volume").alias("p")).distinct()
    pairs = names.join(names.withColumnRenamed("p", "q"), F.col("p") < F.col("q")).withColumn("pair", F.concat_ws("-", "p", "q"))  # of volumes
    a, b = (s.join(pairs.select("pair", F.col(side).alias("volume")), "volume").select("pair", "iz", "iy", "ix") for side in "pq")
    return compare.unequal_supports(a, b)


@query("nested_supports", [*M, SUP], "SELECT volume, iz, iy, ix FROM mean WHERE v_count >= ceil(0.05 * n_times) EXCEPT SELECT volume, iz, iy, ix FROM sup", "volume iz:i iy:i ix:i")
def nested_supports(spark, sf):
    m = _mean(spark, sf)
    return compare.not_nested(m.filter(F.col("v_count") >= F.ceil(0.05 * F.col("n_times"))), m.filter(F.col("u_count") >= F.ceil(0.05 * F.col("n_times"))), VOXEL)


@query("repeated_samples", [FIELD], "SELECT volume, ti, iz, iy, ix, count(*) n FROM field GROUP BY ALL HAVING count(*) > 1", "volume ti:i iz:i iy:i ix:i n:i")
def repeated_samples(spark, sf):
    return compare.repeated(lineitem_field(spark, sf), ["volume", "ti", "iz", "iy", "ix"])


@query("merged_slabs", M, (
    "SELECT * FROM (SELECT volume, ix, avg(v_mean) v_mean, max(v_mean) - min(v_mean) > 5 conflict FROM mean GROUP BY ALL) QUALIFY ix BETWEEN min(ix) OVER "
    "(PARTITION BY volume) + 0.1 * (max(ix) OVER (PARTITION BY volume) - min(ix) OVER (PARTITION BY volume)) AND max(ix) OVER (PARTITION BY volume) - 0.1 "
    "* (max(ix) OVER (PARTITION BY volume) - min(ix) OVER (PARTITION BY volume))"
), "volume ix:i v_mean:d conflict")
def merged_slabs(spark, sf):
    return compare.merged_slabs(_mean(spark, sf), "ix", "v_mean", 5.0, 0.1)


@query("coverage_summary", M, (
    "SELECT volume, count(*) n, count(CASE WHEN u_count >= ceil(0.05 * n_times) THEN 1 END) kept, 100.0 * count(CASE WHEN u_count >= ceil(0.05 * n_times) "
    "THEN 1 END) / count(*) \"percent\" FROM mean GROUP BY volume"
), 'volume n:i kept:i "percent":d')
def coverage_summary(spark, sf):
    m = _mean(spark, sf).withColumn("ok", F.col("u_count") >= F.ceil(0.05 * F.col("n_times")))
    return compare.coverage_summary(m, ["volume"], "ok")


@query("incompatible_grids", [FIELD], (
    "SELECT volume, 'x' axis, ix idx, CAST(ix AS DOUBLE) coord_a, CASE WHEN ix = 3 THEN 3.01 ELSE ix END coord_b FROM (SELECT DISTINCT volume, ix FROM "
    "field) WHERE ix = 3"
), "volume axis idx:i coord_a:d coord_b:d")
def incompatible_grids(spark, sf):
    a = fields.axes_of(lineitem_field(spark, sf), x="ix")
    return compare.grid_differences(a, a.withColumn("coord", F.when(F.col("idx") == 3, 3.01).otherwise(F.col("coord"))))


@query("cell_history", [FIELD, (
    "cell AS (SELECT volume, CAST(floor(ti / 30) AS INTEGER) AS ti, avg(CASE WHEN isfinite(u) AND \"row\" % 3 = 0 THEN u END) AS u FROM field WHERE iz = 1 "
    "AND iy = 2 AND ix = 3 GROUP BY ALL)"
)], "SELECT volume, ti, u raw, avg(u) OVER (PARTITION BY volume) mean, u - avg(u) OVER (PARTITION BY volume) raw_less_mean FROM cell", "volume ti:i raw:d mean:d raw_less_mean:d")
def cell_history(spark, sf):
    g = _grid(spark, sf).filter("iz = 1 and iy = 2 and ix = 3")
    filled = fill.interpolate_line(g, ["volume"], "ti", "t", "u")
    return compare.at_cell(g, filled, stats.temporal_mean(g), ["volume", "iz", "iy", "ix"], "u").select("volume", "ti", "raw", "mean", "raw_less_mean")


# Several volumes, catalogues, workflows


@query("case_labels", [], (
    "SELECT CASE WHEN d <> '' THEN regexp_extract(name, '^(.*)_[0-9.]+D', 1) ELSE split_part(name, '__', 1) END AS \"case\", TRY_CAST(d AS DOUBLE) "
    "distance, count(*) n FROM (SELECT name, regexp_extract(name, '_([0-9]+(\\.[0-9]+)?)D$', 1) d FROM (SELECT CASE WHEN l_linenumber % 2 = 0 THEN "
    "l_returnflag || '__raw' ELSE l_returnflag || '_' || CAST(CAST(l_linenumber AS INTEGER) AS VARCHAR) || '.5D' END AS name FROM lineitem)) GROUP BY ALL"
), '"case" distance:d n:i')
def case_labels(spark, sf):
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    even = F.col("l_linenumber") % 2 == 0
    name = F.concat(F.lit("data/"), F.col("l_returnflag"), F.when(even, "__raw").otherwise(F.concat(F.lit("_"), F.col("l_linenumber").cast("int").cast("string"), F.lit(".5D"))))
    return t.select(*case_label(name)).groupBy("case", "distance").agg(F.count("*").alias("n"))


@query("joint_energy_shares", PH, (
    "SELECT volume, energy, energy / sum(energy) OVER () share FROM (SELECT volume, sum(pow(phase_mean - mean, 2) / n) energy FROM (SELECT *, count(*) "
    "OVER (PARTITION BY iz, iy, ix, component, phase_bin) n FROM averages WHERE phase_mean IS NOT NULL) GROUP BY volume)"
), "volume energy:d share:d")
def joint_energy_shares(spark, sf):
    return multi.source_shares(_averages(spark, sf))


@query("joint_pod_energy", PH, (
    f"SELECT sum(x * x) / {BINS} / 2 energy FROM (SELECT phase_bin, iz, iy, ix, component, c - avg(c) OVER (PARTITION BY iz, iy, ix, component) x, count(*) "
    "OVER (PARTITION BY iz, iy, ix, component) n FROM (SELECT phase_bin, iz, iy, ix, component, avg(phase_mean - mean) c FROM averages WHERE phase_mean IS "
    f"NOT NULL GROUP BY ALL)) WHERE n = {BINS}"
), "energy:d")
def joint_pod_energy(spark, sf):
    spectrum, _, _ = multi.joint_pod(_averages(spark, sf), BINS)
    return spectrum.agg(F.sum("energy").alias("energy"))


@query("surface_points", M, "SELECT volume, axis, iz, iy, ix FROM (" + " UNION ALL ".join(f"SELECT a.volume, 'i{x}' axis, " + ", ".join(f"a.i{y}" + (f" + (52.0 - a.v_mean) / (b.v_mean - a.v_mean)" if x == y else "") + f" i{y}" for y in "zyx") + f" FROM mean a JOIN mean b ON a.volume = b.volume AND " + " AND ".join(f"b.i{y} = a.i{y}" + (" + 1" if x == y else "") for y in "zyx") + " WHERE (a.v_mean < 52.0) <> (b.v_mean < 52.0)" for x in "zyx") + ")", "volume axis iz:d iy:d ix:d")
def surface_points(spark, sf):
    return multi.surface_points(_mean(spark, sf), ["volume"], "v_mean", 52.0)


@query("common_slab", [FIELD, (
    "al AS (SELECT volume, ti, iy, ix, 0.5 * a + 0.5 * b AS u FROM (SELECT volume, ti, iy, ix, max(CASE WHEN iz = 1 THEN u END) a, max(CASE WHEN iz = 2 "
    "THEN u END) b FROM (SELECT volume, CAST(floor(ti / 30) AS INTEGER) ti, iz, iy, ix, avg(CASE WHEN isfinite(u) AND \"row\" % 3 = 0 THEN u END) u FROM "
    "field GROUP BY ALL) GROUP BY ALL HAVING count(CASE WHEN iz IN (1, 2) THEN 1 END) > 0))"
), "vx AS (SELECT volume, iy, ix, count(u) n, avg(u) u FROM al GROUP BY ALL)", "nt AS (SELECT volume, count(DISTINCT ti) nt FROM al GROUP BY volume)"], (
    "SELECT volume, ix, avg(u) u_mean, count(*) n FROM vx JOIN (SELECT iy, ix FROM vx JOIN nt USING (volume) GROUP BY ALL HAVING bool_and(n >= ceil(0.05 * "
    "nt) AND n >= 2) AND count(DISTINCT volume) = (SELECT count(*) FROM nt)) USING (iy, ix) GROUP BY ALL"
), "volume ix:i u_mean:d n:i")
def common_slab(spark, sf):
    g = _grid(spark, sf).withColumn("z", F.col("iz").cast("double"))
    targets = g.select("volume").distinct().withColumns({"idx": F.lit(0), "z": F.lit(1.5)})
    return multi.common_slab(g, targets, 0.05)


@query("sinusoid_pair", [SIGNAL, "two AS (SELECT CASE WHEN id % 2 = 0 THEN 1 ELSE 2 END AS mode, t / 86400 AS d, value AS a FROM signal WHERE value IS NOT NULL)", (
    "m AS (SELECT mode, avg(a) my, avg(c) mc, avg(s) ms, covar_pop(c, c) cc, covar_pop(s, s) ss, covar_pop(c, s) cs, covar_pop(c, a) cy, covar_pop(s, a) "
    "sy, var_pop(a) yy FROM (SELECT *, cos(2 * pi() * d) c, sin(2 * pi() * d) s FROM two) GROUP BY mode)"
), "f AS (SELECT mode, (cy * ss - sy * cs) / (cc * ss - cs * cs) a, (sy * cc - cy * cs) / (cc * ss - cs * cs) b, cy, sy, yy FROM m)"],
 (
     "SELECT p.r2 r2_1, q.r2 r2_2, p.amp amplitude_1, q.amp amplitude_2, (degrees(q.ph - p.ph) + 180) - 360 * floor((degrees(q.ph - p.ph) + 180) / 360) - "
     "180 difference FROM (SELECT (a * cy + b * sy) / yy r2, sqrt(a * a + b * b) amp, atan2(-b, a) ph FROM f WHERE mode = 1) p CROSS JOIN (SELECT (a * cy + "
     "b * sy) / yy r2, sqrt(a * a + b * b) amp, atan2(-b, a) ph FROM f WHERE mode = 2) q"
 ), "r2_1:d r2_2:d amplitude_1:d amplitude_2:d difference:d")
def sinusoid_pair(spark, sf):
    s = event_signal(spark, sf).select(F.when(F.col("id") % 2 == 0, 1).otherwise(2).alias("mode"), (F.col("t") / DAY).alias("t"), F.col("value").alias("a"))
    return pod.sinusoid_pair(s, 1.0).select("r2_1", "r2_2", "amplitude_1", "amplitude_2", "difference")


@query("modal_band", SP, (
    "SELECT sum(s * f) band_fraction_of_total, sum(s) saved_fraction, sum(s * f) * 10 band_energy, sum(s * f) / sum(s) band_fraction_of_saved FROM (SELECT "
    "series, sum(CASE WHEN frequency BETWEEN 0.02 AND 0.1 THEN psd ELSE 0 END) / sum(psd) f, 0.1 s FROM psd WHERE k > 0 GROUP BY series)"
), "band_fraction_of_total:d saved_fraction:d band_energy:d band_fraction_of_saved:d")
def modal_band(spark, sf):
    p = _psd(spark, sf).withColumnRenamed("series", "mode")
    return spectra.modal_band(p, p.select("mode").distinct().withColumn("fraction", F.lit(0.1)), 0.02, 0.1, 10.0).drop("last_frequency")


@query("common_extents", [FIELD], (
    "SELECT low, high, low + (high - low) / 3 third, (low + high) / 2 centre, low + (high - low) * 2 / 3 two_thirds FROM (SELECT max(lo) low, min(hi) high "
    "FROM (SELECT volume, CAST(min(ti) AS DOUBLE) lo, CAST(max(ti) AS DOUBLE) hi FROM field GROUP BY volume))"
), "low:d high:d third:d centre:d two_thirds:d")
def common_extents(spark, sf):
    f = lineitem_field(spark, sf)
    return regrid.extents(fields.axes_of(f.withColumn("ix", F.col("ti")), x="ti"), "x")


@query("aligned_counts", [FIELD, (
    "g AS (SELECT volume, CAST(floor(ti / 30) AS INTEGER) ti, iz, iy, ix, avg(CASE WHEN isfinite(u) AND \"row\" % 3 = 0 THEN u END) u FROM field GROUP BY "
    "ALL)"
), "al AS (SELECT volume, ti, iy, ix, CASE WHEN count(u) = 2 THEN 1 END ok FROM g WHERE iz IN (1, 2) GROUP BY ALL)"], (
    "SELECT volume, iy, ix, count(ok) n, n_times FROM al JOIN (SELECT volume, count(DISTINCT ti) n_times FROM al GROUP BY volume) USING (volume) GROUP BY "
    "ALL"
), "volume iy:i ix:i n:i n_times:i")
def aligned_counts(spark, sf):
    g = _grid(spark, sf).withColumn("z", F.col("iz").cast("double"))
    targets = g.select("volume").distinct().withColumns({"idx": F.lit(0), "z": F.lit(1.5)})
    return regrid.valid_counts(g, "z", "z", targets).select("volume", "iy", "ix", "n", "n_times")
