"""Queries of whole workflows over the general tables, each with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog_of_queries import ACT, BINS, CYCLE, FIELD, M, MEAN, OFFSET, PERIOD, PH, PHASED, REACH, SG, SW, TIMES, U_INF, W_, _active, _averages, _grid, _mean, _swirl, _wake, query
from .operators import compare, energy, fill, freeflow, multi, phase, pod, regrid, vortex, wake
from .plans import workflows
from .plans.lineage import cut
from .sources import fields
from .sources.fields import lineitem_field

# Filling gaps in passes

GRID = """g AS (SELECT volume, CAST(floor(ti / 30) AS INTEGER) AS ti, iz, iy, ix, avg(CASE WHEN isfinite(u) AND "row" % 3 = 0 THEN u END) AS u,
 avg(v) AS v, avg(w) AS w FROM field GROUP BY ALL)"""


def _filled(source: str, index: str, others: str, limit: str) -> str:
    """One pass over `source` along an index."""
    return f"""SELECT volume, ti, iz, iy, ix, coalesce(u, CASE WHEN l IS NOT NULL AND r IS NOT NULL AND {limit}
 THEN l + ({index} - li) / CAST(ri - li AS DOUBLE) * (r - l) END) AS u FROM (SELECT *, last_value(u IGNORE NULLS) OVER b AS l,
 last_value(CASE WHEN u IS NOT NULL THEN {index} END IGNORE NULLS) OVER b AS li, first_value(u IGNORE NULLS) OVER a AS r,
 first_value(CASE WHEN u IS NOT NULL THEN {index} END IGNORE NULLS) OVER a AS ri FROM {source}
 WINDOW b AS (PARTITION BY {others} ORDER BY {index} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 a AS (PARTITION BY {others} ORDER BY {index} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""


IN_TIME = ("ti", "volume, iz, iy, ix", "ti - li <= 2 AND ri - ti <= 2")
IN_SPACE = ("ix", "volume, ti, iz, iy", "ri - li <= 3")
PASSES = [f"p1 AS ({_filled('g', *IN_TIME)})", f"p2 AS ({_filled('p1', *IN_SPACE)})", f"p3 AS ({_filled('p2', *IN_TIME)})", f"p4 AS ({_filled('p3', *IN_SPACE)})"]


@query("gap_fill_passes", [FIELD, GRID, *PASSES], "SELECT volume, count(*) n, count(p4.u) - count(g.u) n_filled, avg(p4.u) u FROM p4 JOIN g USING (volume, ti, iz, iy, ix) GROUP BY volume", "volume n:i n_filled:i u:d")
def gap_fill_passes(spark, sf):
    out = fill.fill(_grid(spark, sf), ("t", "x"), ("u",), 2, 3, 2)
    return out.groupBy("volume").agg(F.count("*").alias("n"), F.count_if("u_filled").alias("n_filled"), F.avg("u").alias("u"))


# Decompositions whose eigenvalues have a closed form: three degrees of freedom

THREE = [
    FIELD,
    "three AS (SELECT ti AS snapshot, ix % 3 AS dof, avg(v) AS value FROM field GROUP BY ALL)",
    "flu AS (SELECT snapshot, dof, value - avg(value) OVER (PARTITION BY dof) AS x FROM three)",
    "wide AS (SELECT snapshot, " + ", ".join(f"coalesce(max(CASE WHEN dof = {i} THEN x END), 0) AS x{i}" for i in range(3)) + " FROM flu GROUP BY snapshot)",
    "m AS (SELECT " + ", ".join(f"sum(x{i} * x{j}) / count(*) AS m{i}{j}" for i in range(3) for j in range(i, 3)) + " FROM wide)",
    "q AS (SELECT *, (m00 + m11 + m22) / 3 AS q FROM m)",
    "p AS (SELECT *, sqrt((pow(m00 - q, 2) + pow(m11 - q, 2) + pow(m22 - q, 2) + 2 * (m01 * m01 + m02 * m02 + m12 * m12)) / 6) AS p FROM q)",
    """f AS (SELECT *, acos(greatest(-1, least(1, ((m00 - q) * ((m11 - q) * (m22 - q) - m12 * m12) - m01 * (m01 * (m22 - q) - m12 * m02)
 + m02 * (m01 * m12 - (m11 - q) * m02)) / (2 * p * p * p)))) / 3 AS f FROM p)""",
    "l AS (SELECT *, q + 2 * p * cos(f) AS l1, 3 * q - (q + 2 * p * cos(f)) - (q + 2 * p * cos(f + 2 * pi() / 3)) AS l2, q + 2 * p * cos(f + 2 * pi() / 3) AS l3 FROM f)",
]


def _three(spark: SparkSession, sf: str) -> DataFrame:
    f = lineitem_field(spark, sf)
    return f.groupBy(F.col("ti").alias("snapshot"), (F.col("ix") % 3).alias("dof")).agg(F.avg("v").alias("value"))


TABLE = "SELECT l1 / (3 * q) first_1, (l1 + l2) / (3 * q) first_2, (l1 + l2 + l3) / (3 * q) first_5, (l1 + l2 + l3) / (3 * q) first_10, (l1 + l2 + l3) / (3 * q) first_20 FROM l"
SHARES = "first_1:d first_2:d first_5:d first_10:d first_20:d"


@query("mode_energy_table", THREE, TABLE, SHARES)
def mode_energy_table(spark, sf):
    spectrum, _, _ = pod.decompose(_three(spark, sf), 20)
    return pod.threshold_table(pod.cumulative_energy(spectrum, []), [])


@query("randomised_modes", THREE, TABLE, SHARES)
def randomised_modes(spark, sf):
    spectrum, _, _ = pod.decompose_randomised(_three(spark, sf), 3, 1)
    return pod.threshold_table(spectrum, [])


VECTORS = [
    *THREE,
    "e AS (" + " UNION ALL ".join(f"SELECT {k} AS mode, m01 * m12 - m02 * (m11 - l{k}) AS e0, m02 * m01 - (m00 - l{k}) * m12 AS e1, (m00 - l{k}) * (m11 - l{k}) - m01 * m01 AS e2 FROM l" for k in (1, 2, 3)) + ")",
    (
        "n AS (SELECT mode, e0 / s AS e0, e1 / s AS e1, e2 / s AS e2 FROM (SELECT *, sqrt(e0 * e0 + e1 * e1 + e2 * e2) * CASE WHEN abs(e0) >= abs(e1) AND "
        "abs(e0) >= abs(e2) THEN sign(e0) WHEN abs(e1) >= abs(e2) THEN sign(e1) ELSE sign(e2) END AS s FROM e))"
    ),
]


@query("mode_orthogonality", VECTORS, "SELECT a.mode i, b.mode j, a.e0 * b.e0 + 2 * a.e1 * b.e1 + 3 * a.e2 * b.e2 g FROM n a JOIN n b ON a.mode <= b.mode", "i:i j:i g:d")
def mode_orthogonality(spark, sf):
    _, modes, _ = pod.decompose(_three(spark, sf), 3)
    weights = spark.range(3).select(F.col("id").cast("int").alias("dof"), (F.col("id") + 1.0).alias("weight"))
    return pod.mode_gram(modes, weights)


@query("mode_coefficients", VECTORS, "SELECT snapshot, mode, x0 * e0 + x1 * e1 + x2 * e2 a FROM wide CROSS JOIN n", "snapshot:i mode:i a:d")
def mode_coefficients(spark, sf):
    return pod.decompose(_three(spark, sf), 3)[2].select("snapshot", "mode", "a")


# Pulsing of wakes

PULSE = [
    *PH,
    f"""pc AS (SELECT volume, ix, phase_bin, ({U_INF} - phase_mean) / {U_INF} AS d, iy - 2.0 AS y, iz - 1.5 AS z,
 count(phase_mean) OVER (PARTITION BY volume, ix, iz, iy) = {BINS} AS held FROM averages WHERE component = 'u')""",
    (
        "ps AS (SELECT volume, ix, phase_bin, avg(d) AS mean_deficit, sum(CASE WHEN d > 0 THEN d * y END) / sum(CASE WHEN d > 0 THEN d END) AS y, sum(CASE "
        "WHEN d > 0 THEN d * z END) / sum(CASE WHEN d > 0 THEN d END) AS z FROM pc WHERE held GROUP BY ALL)"
    ),
    f"pl AS (SELECT volume, ix, value, x, cos((phase_bin + 0.5) * 2 * pi() / {BINS}) AS c, sin((phase_bin + 0.5) * 2 * pi() / {BINS}) AS s FROM (" + " UNION ALL ".join(f"SELECT volume, ix, phase_bin, '{v}' AS value, {v} AS x FROM ps" for v in ("mean_deficit", "y", "z")) + ") WHERE x IS NOT NULL)",
    """pm AS (SELECT volume, ix, value, count(*) AS n, avg(x) AS mx, avg(c) AS mc, avg(s) AS ms, covar_pop(c, c) AS cc, covar_pop(s, s) AS ss, covar_pop(c, s) AS cs,
 covar_pop(c, x) AS cx, covar_pop(s, x) AS sx FROM pl GROUP BY ALL)""",
    (
        "pf AS (SELECT *, CASE WHEN n >= 3 AND cc * ss - cs * cs > 1e-10 THEN (cx * ss - sx * cs) / (cc * ss - cs * cs) END AS a, CASE WHEN n >= 3 AND cc * ss "
        "- cs * cs > 1e-10 THEN (sx * cc - cx * cs) / (cc * ss - cs * cs) END AS b FROM pm)"
    ),
    "po AS (SELECT volume, ix, value, n, a, b, mx - a * mc - b * ms AS offs FROM pf)",
    """pulse AS (SELECT volume, ix, value, any_value(n) AS n, any_value(offs) AS "offset", any_value(sqrt(a * a + b * b)) AS amplitude,
 CASE WHEN sum(pow(x - offs, 2)) > 1e-24 THEN 1 - sum(pow(x - offs - a * c - b * s, 2)) / sum(pow(x - offs, 2)) END AS r2 FROM pl JOIN po USING (volume, ix, value) GROUP BY ALL)""",
]


def _pulsing(spark: SparkSession, sf: str) -> DataFrame:
    a = _averages(spark, sf).filter("component = 'u'")
    cells = a.select("volume", "ix", "iz", "iy", "phase_bin", ((U_INF - F.col("phase_mean")) / U_INF).alias("deficit"), F.lit(1.0).alias("area"), (F.col("iy") - 2.0).alias("y"), (F.col("iz") - 1.5).alias("z"))
    series = wake.fixed_support(cells, ["volume", "ix"], ["iz", "iy"], "phase_bin", "deficit", "area", BINS)
    return multi.pulsing(series, ["volume", "ix"], BINS).select("volume", "ix", "value", "n", "offset", "amplitude", "r2")


@query("wake_pulsing", PULSE, "SELECT * FROM pulse", 'volume ix:i value n:i "offset":d amplitude:d r2:d')
def wake_pulsing(spark, sf):
    return _pulsing(spark, sf)


@query("shown_pulsing", PULSE, "SELECT volume, ix, value, amplitude, r2 FROM pulse WHERE ix = 3 AND r2 > 0.05", "volume ix:i value amplitude:d r2:d")
def shown_pulsing(spark, sf):
    return wake.gated(_pulsing(spark, sf), ["volume", "value"], "ix", 3.2, "r2", 0.05).select("volume", "ix", "value", "amplitude", "r2")


# Free flows

LAGS, PROBE = 6, (1, 2, 3)
PRIMES = " UNION ALL ".join(f"SELECT volume, iz, iy, ix, ti, '{c}' AS component, {c} - avg({c}) OVER (PARTITION BY volume, iz, iy, ix) AS prime FROM g WHERE {c} IS NOT NULL" for c in "uvw")
SAME = {"x": ("ti", "iz", "iy"), "y": ("ti", "iz", "ix"), "z": ("ti", "iy", "ix"), "t": ("iz", "iy", "ix")}


def _lagged(axis: str) -> str:
    at = "ti" if axis == "t" else f"i{axis}"
    here = " AND a.iz = 1 AND a.iy = 2 AND a.ix = 3" if axis == "t" else ""
    return f"""SELECT a.volume, a.component, '{axis}' AS axis, b.{at} - a.{at} AS lag, count(*) AS n, sum(a.prime * b.prime) AS ab, sum(a.prime * a.prime) AS aa, sum(b.prime * b.prime) AS bb
 FROM primes a JOIN primes b ON a.volume = b.volume AND a.component = b.component AND {' AND '.join(f'a.{c} = b.{c}' for c in SAME[axis])} AND b.{at} BETWEEN a.{at} AND a.{at} + {LAGS}{here} GROUP BY ALL"""


FREE = [
    FIELD, GRID, f"primes AS ({PRIMES})", f"lagged AS ({' UNION ALL '.join(map(_lagged, 'xyzt'))})",
    "rhos AS (SELECT volume, component, axis, lag, n, CASE WHEN aa * bb > 0 THEN least(greatest(ab / sqrt(aa * bb), -1), 1) END AS rho FROM lagged)",
    """steps AS (SELECT *, lead(rho) OVER w AS nxt, max(CASE WHEN rho IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY volume, component, axis ORDER BY lag ROWS UNBOUNDED PRECEDING) AS bad
 FROM rhos WINDOW w AS (PARTITION BY volume, component, axis ORDER BY lag))""",
    "firsts AS (SELECT *, min(CASE WHEN bad = 0 AND rho > 0 AND nxt <= 0 THEN lag END) OVER (PARTITION BY volume, component, axis) AS first_lag FROM steps)",
    """scales AS (SELECT volume, component, axis, sum(CASE WHEN lag = first_lag THEN rho * (rho / (rho - nxt)) / 2 WHEN bad = 0 AND nxt IS NOT NULL AND (first_lag IS NULL OR lag < first_lag) THEN (rho + nxt) / 2 END) AS area,
 max(CASE WHEN lag = first_lag THEN lag + rho / (rho - nxt) END) AS zero, max(bad) AS bad, max(CASE WHEN lag = 0 THEN rho END) AS rho0 FROM firsts GROUP BY ALL)""",
]


def _free(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return workflows.Engine(_grid(spark, sf)).characterise(LAGS, probe=PROBE)


@query("free_flow_correlations", FREE, "SELECT volume, component, axis, lag, n, rho FROM rhos WHERE axis <> 't'", "volume component axis lag:i n:i rho:d")
def free_flow_correlations(spark, sf):
    return _free(spark, sf)["correlations"].select("volume", "component", "axis", "lag", "n", "rho")


@query(
    "free_flow_scale", [*FREE, "flow AS (SELECT volume, abs(avg(u)) AS speed FROM g WHERE iz = 1 AND iy = 2 AND ix = 3 GROUP BY volume)"],
    """SELECT volume, component, axis, CASE WHEN zero IS NOT NULL THEN area END scale, zero, CASE WHEN zero IS NULL THEN area END truncated,
 CASE WHEN zero IS NOT NULL THEN 'first_zero_crossing' WHEN rho0 IS NULL THEN 'insufficient_pairs_or_zero_variance' WHEN bad = 1 THEN 'insufficient_pairs_before_zero' ELSE 'no_zero_crossing' END status,
 CASE WHEN zero IS NOT NULL THEN area END * CASE WHEN axis = 't' THEN speed ELSE 1 END length FROM scales LEFT JOIN flow USING (volume)""",
    "volume component axis scale:d zero:d truncated:d status length:d",
)
def free_flow_scale(spark, sf):
    return _free(spark, sf)["scales"]


# Response to forcing


def _budgets(more: str = "") -> list[str]:
    """CTEs up to the budget of each voxel; more: what samples have to fulfil."""
    v = "volume, iz, iy, ix"
    return [
        FIELD, PHASED, f"good AS (SELECT *, {CYCLE} AS cycle, cos(phase) AS c, sin(phase) AS s1 FROM phased {more})",
        f"cells AS (SELECT {v}, phase_bin, cycle, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM good GROUP BY ALL)",
        f"by_bin AS (SELECT {v}, phase_bin, sum(n) AS bn, sum(s) AS bs FROM cells GROUP BY ALL)",
        f"by_key AS (SELECT {v}, sum(n) AS kn, sum(s) AS ks, sum(q) AS kq FROM cells GROUP BY ALL)",
        f"by_cycle AS (SELECT {v}, cycle, sum(n) AS cn, sum(s) AS cs, sum(q) AS cq FROM cells GROUP BY ALL)",
        f"""locked AS (SELECT {v}, max(kn) AS n, count(*) AS n_bins, min(bn) AS least, max(kq / kn - pow(ks / kn, 2)) / 2 AS total,
 sum(bn * pow(bs / bn - ks / kn, 2)) / max(kn) / 2 AS locked FROM by_bin JOIN by_key USING ({v}) GROUP BY ALL)""",
        f"""cvp AS (SELECT {v}, bool_and(bn > n) AS p, sum(q - 2 * (bs - s) / nullif(bn - n, 0) * s + n * pow((bs - s) / nullif(bn - n, 0), 2)) AS ps, sum(n) AS pn
 FROM cells JOIN by_bin USING ({v}, phase_bin) GROUP BY ALL)""",
        (
            f"cvm AS (SELECT {v}, bool_and(kn > cn) AS m, sum(cq - 2 * (ks - cs) / nullif(kn - cn, 0) * cs + cn * pow((ks - cs) / nullif(kn - cn, 0), 2)) AS ms "
            f"FROM by_cycle JOIN by_key USING ({v}) GROUP BY ALL)"
        ),
        f"h AS (SELECT {v}, covar_pop(c, c) AS cc, covar_pop(s1, s1) AS ss, covar_pop(c, s1) AS cs, covar_pop(c, v) AS cy, covar_pop(s1, v) AS sy FROM good GROUP BY ALL)",
        f"""bm AS (SELECT {v}, covar_pop(c, c) AS cc, covar_pop(s, s) AS ss, covar_pop(c, s) AS cs, covar_pop(c, y) AS cy, covar_pop(s, y) AS sy FROM
 (SELECT {v}, bs / bn AS y, cos((phase_bin + 0.5) * 2 * pi() / {BINS}) AS c, sin((phase_bin + 0.5) * 2 * pi() / {BINS}) AS s FROM by_bin) GROUP BY ALL)""",
        f"fh AS (SELECT {v}, ((cy * ss - sy * cs) * cy + (sy * cc - cy * cs) * sy) / (cc * ss - cs * cs) / 2 AS forcing FROM h WHERE cc * ss - cs * cs > 1e-10)",
        f"fu AS (SELECT {v}, 0.25 * (pow((cy * ss - sy * cs) / (cc * ss - cs * cs), 2) + pow((sy * cc - cy * cs) / (cc * ss - cs * cs), 2)) AS uniform FROM bm WHERE cc * ss - cs * cs > 1e-10)",
        f"""vox AS (SELECT {v}, total, forcing, uniform, locked, total - locked AS residual, CASE WHEN p THEN ps / pn / 2 END AS cv_phase, CASE WHEN m THEN ms / pn / 2 END AS cv_mean
 FROM locked LEFT JOIN fh USING ({v}) LEFT JOIN fu USING ({v}) JOIN cvp USING ({v}) JOIN cvm USING ({v}) WHERE n >= 3 AND n_bins = {BINS} AND least >= 1)""",
    ]


PARTS = " ".join(f"{c}:d" for c in energy.BUDGET)
WHOLE = ", ".join(f"CASE WHEN count(*) = count({c}) THEN avg({c}) END {c}" for c in energy.BUDGET)


@query("forcing_response", _budgets(), f"SELECT volume, {WHOLE} FROM vox GROUP BY volume", f"volume {PARTS}")
def forcing_response(spark, sf):
    return workflows.Engine(lineitem_field(spark, sf)).forcing_response(BINS, 1 / PERIOD, "v", OFFSET)["volumes"]


CANDIDATES = (
    "SEMI JOIN (SELECT volume, iz, iy, ix FROM field JOIN (SELECT volume, count(DISTINCT ti) AS f FROM field GROUP BY volume) USING (volume) WHERE iz "
    "BETWEEN 1 AND 3 GROUP BY volume, iz, iy, ix HAVING count(v) >= ceil(0.03 * any_value(f))) USING (volume, iz, iy, ix)"
)
SLAB_ROWS = ", ".join(f"CASE WHEN count(*) = count({c}) THEN sum({c} * wt) / sum(wt) END {c}" for c in energy.BUDGET)


@query(
    "forcing_slabs", _budgets(CANDIDATES),
    (
        f"SELECT volume, slab, count(*) n, sum(wt) weight, {SLAB_ROWS} FROM (SELECT *, least(ix + 0.5, hi) - greatest(ix - 0.5, lo) wt FROM vox CROSS JOIN "
        "(VALUES ('near', 0.5, 2.75), ('far', 2.75, 9.0)) s(slab, lo, hi) WHERE ix + 0.5 > lo AND ix - 0.5 < hi) GROUP BY volume, slab"
    ),
    f"volume slab n:i weight:d {PARTS}",
)
def forcing_slabs(spark, sf):
    picked = energy.candidates(lineitem_field(spark, sf), "v", 0.03, iz=(1, 3))
    slabs = spark.createDataFrame([("near", 0.5, 2.75), ("far", 2.75, 9.0)], "slab string, from_ double, to double")
    return workflows.Engine(picked).forcing_response(BINS, 1 / PERIOD, "v", OFFSET, slabs=slabs)["slabs"]


# Joint decomposition on a common grid: each volume's x axis is shifted by half a step against the one before

SHIFT = "CASE volume WHEN 'A' THEN 0.0 WHEN 'N' THEN 0.5 ELSE 1.0 END"
JOINT = [
    *PH,
    f"shifted AS (SELECT volume, component, phase_bin, iz, iy, ix + {SHIFT} AS x, phase_mean - mean AS c FROM averages WHERE phase_mean IS NOT NULL)",
    "targets AS (SELECT unnest(range(CAST(floor(min(x)) AS BIGINT), CAST(floor(max(x)) AS BIGINT) + 1)) AS tx FROM shifted)",
    """onto AS (SELECT volume, component, phase_bin, iz, iy, tx, sum(c * (1 - abs(x - tx))) AS c FROM shifted JOIN targets ON abs(x - tx) < 1
 GROUP BY ALL HAVING abs(sum(1 - abs(x - tx)) - 1) < 1e-9)""",
    "mixed AS (SELECT component, phase_bin, iz, iy, tx, avg(c) AS c FROM onto GROUP BY ALL)",
    "centred AS (SELECT *, c - avg(c) OVER w AS x, count(*) OVER w AS n FROM mixed WINDOW w AS (PARTITION BY component, iz, iy, tx))",
]


@query("joint_grid_energy", JOINT, f"SELECT sum(x * x) / {BINS} / 2 energy, count(DISTINCT (component, iz, iy, tx)) n_dofs FROM centred WHERE n = {BINS}", "energy:d n_dofs:i")
def joint_grid_energy(spark, sf):
    averages = cut(_averages(spark, sf))
    shift = F.when(F.col("volume") == "A", 0.0).when(F.col("volume") == "N", 0.5).otherwise(1.0)
    axes = cut(fields.axes_of(averages.withColumn("xx", F.col("ix") + shift), z="iz", y="iy", x="xx"))
    spectrum, modes, _ = multi.joint_pod_on_grid(averages, axes, multi.uniform_targets(axes), BINS)
    return spectrum.agg(F.sum("energy").alias("energy")).crossJoin(modes.select("dof").distinct().agg(F.count("*").alias("n_dofs")))  # a row each


# Vortices, planes and profiles

NINE = ACT.replace("quantile_cont(s, 0.7)", "quantile_cont(s, 0.9)")


@query(
    "vortex_detection", ["RECURSIVE " + FIELD, TIMES, MEAN, SW, SG, NINE, REACH],
    (
        "SELECT volume, row_number() OVER (PARTITION BY volume ORDER BY root) component, size, peak, integral, pow(6 * size / pi(), 1 / 3.0) diameter FROM "
        "(SELECT volume, root, count(*) size, max(s) peak, sum(s) integral FROM act JOIN (SELECT volume, c, min(r) root FROM reach GROUP BY ALL) USING "
        "(volume, c) GROUP BY ALL)"
    ),
    "volume component:i size:i peak:d integral:d diameter:d",
)
def vortex_detection(spark, sf):
    return workflows.detect_vortices(_swirl(spark, sf), ["volume"], "s", "p90").select("volume", "component", "size", "peak", "integral", "diameter")


@query("wake_profile", W_, "SELECT volume, iz, iy, ix, iy / 2.0 coordinate, deficit FROM wake WHERE iz = 1 AND ix = 3", "volume iz:i iy:i ix:i coordinate:d deficit:d")
def wake_profile(spark, sf):
    mean = _mean(spark, sf)
    return wake.profile(mean, fields.axes_of(mean, z="iz", y="iy", x="ix"), "y", {"z": 1.4}, U_INF, 2.0, 3.2)


@query("bilinear_plane", M, """SELECT volume, iz, px x, py y, sum(wt * v_mean) v FROM (SELECT volume, iz, v_mean, px, py, (1 - abs(ix - px)) * (1 - abs(iy - py)) wt FROM mean
 CROSS JOIN (VALUES (1.5), (3.25), (7.0)) a(px) CROSS JOIN (VALUES (0.5), (2.0), (3.75)) b(py) WHERE abs(ix - px) < 1 AND abs(iy - py) < 1) GROUP BY ALL""", "volume iz:i x:d y:d v:d")
def bilinear_plane(spark, sf):
    plane = _mean(spark, sf).select("volume", "iz", F.col("iy").cast("double").alias("y"), F.col("ix").cast("double").alias("x"), F.col("v_mean").alias("v"))
    xs, ys = (spark.createDataFrame([(float(p),) for p in at], f"{name} double") for name, at in (("x", (1.5, 3.25, 7.0)), ("y", (0.5, 2.0, 3.75))))
    return regrid.bilinear(plane, ["volume", "iz"], xs, ys, "v")


@query("centred_phases", PH, (
    "SELECT volume, ix, phase_bin, d - avg(d) OVER (PARTITION BY volume, ix) d FROM (SELECT volume, ix, phase_bin, avg(phase_mean) d FROM averages WHERE "
    "component = 'v' GROUP BY ALL)"
), "volume ix:i phase_bin:i d:d")
def centred_phases(spark, sf):
    rows = _averages(spark, sf).filter("component = 'v'").groupBy("volume", "ix", "phase_bin").agg(F.avg("phase_mean").alias("d"))
    return wake.about_phase_mean(rows, ["volume", "ix"], "d")


@query("display_mask_strict", PH, f"SELECT volume, iz, iy, ix, component, bool_and(coalesce(phase_count / bin_frames, 0) > 0.02) AND count(*) = {BINS} shown FROM averages GROUP BY ALL", "volume iz:i iy:i ix:i component shown")
def display_mask_strict(spark, sf):
    return phase.all_bins(_averages(spark, sf), BINS, 0.02, strict=True).drop("least_share")


@query("report_order", M, (
    "SELECT volume, ix, row_number() OVER (ORDER BY d ASC NULLS LAST, ix, volume) - 1 place FROM (SELECT DISTINCT volume, ix, CASE WHEN volume <> 'R' THEN "
    "ix % 3 END d FROM mean)"
), "volume ix:i place:i")
def report_order(spark, sf):
    rows = _mean(spark, sf).select("volume", "ix").distinct().withColumn("distance", F.when(F.col("volume") != "R", F.col("ix") % 3))
    return compare.ordered_groups(rows.withColumn("label", F.col("volume")), "volume", "distance", "ix").select("volume", "ix", "place")


@query("plane_view", [FIELD], "SELECT volume, ti, count(*) n, avg(v) v FROM field WHERE iy = 2 AND ti % 50 = 0 GROUP BY ALL", "volume ti:i n:i v:d")
def plane_view(spark, sf):
    return fields.plane(lineitem_field(spark, sf), "y", 2).filter("ti % 50 = 0").groupBy("volume", "ti").agg(F.count("*").alias("n"), F.avg("v").alias("v"))


@query("any_filled", [FIELD], "SELECT volume, count(CASE WHEN ix > 5 OR filled THEN 1 END) n FROM field GROUP BY volume", "volume n:i")
def any_filled(spark, sf):
    f = lineitem_field(spark, sf).withColumns({"u_filled": F.col("ix") > 5, "w_filled": F.col("filled")})
    return freeflow.any_filled(f).groupBy("volume").agg(F.count_if("filled").alias("n"))


WIDTHS = (
    "SELECT volume, idx, {} width FROM (SELECT volume, ix idx, coord - lag(coord) OVER w b, lead(coord) OVER w - coord a FROM (SELECT DISTINCT volume, ix, "
    "CAST(ix * ix AS DOUBLE) coord FROM field) WINDOW w AS (PARTITION BY volume ORDER BY ix))"
)


@query("cell_widths_full", [FIELD], WIDTHS.format("CASE WHEN b IS NULL OR a IS NULL THEN coalesce(a, b, 1) ELSE (a + b) / 2 END"), "volume idx:i width:d")
def cell_widths_full(spark, sf):
    axes = fields.axes_of(lineitem_field(spark, sf).withColumn("x2", F.col("ix") * F.col("ix")), x="x2")
    return regrid.centre_widths(axes, "full").select("volume", "idx", "width")


@query("line_deficit", W_, "SELECT volume, ix, avg(deficit) mean, count(deficit) n FROM wake WHERE iz = 1 AND abs(y) <= 1 GROUP BY ALL", "volume ix:i mean:d n:i")
def line_deficit(spark, sf):
    return wake.integrated(_wake(spark, sf), ["volume", "ix"], "deficit", wake.line(F.col("y"), F.col("iz"), 1, 1.0)).filter("n > 0")


PAIRED = """pairs AS (SELECT a.volume || '-' || b.volume AS pair, a.v_mean AS x, b.v_mean AS y FROM mean a JOIN mean b ON a.volume < b.volume AND a.iz = b.iz AND a.iy = b.iy AND a.ix = b.ix),
 ranked AS (SELECT *, rank() OVER (PARTITION BY pair ORDER BY x) + (count(*) OVER (PARTITION BY pair, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY pair ORDER BY y) + (count(*) OVER (PARTITION BY pair, y) - 1) / 2.0 AS ry FROM pairs)"""
HIGH = ", ".join(f"(quantile_cont(x, {p}) - quantile_cont(y, {p})) / abs(quantile_cont(y, {p})) p{n}_relative" for p, n in ((0.9, "90"), (0.95, "95"), (0.975, "97_5"), (0.99, "99")))


@query(
    "field_comparison", [*M, PAIRED],
    (
        "SELECT pair, count(*) n, avg(abs(x - y)) mae, sqrt(avg((x - y) * (x - y))) rms, sqrt(avg((x - y) * (x - y))) / sqrt(avg(y * y)) nrms, max(abs(x - y)) "
        f"max_difference, corr(x, y) pearson, corr(rx, ry) spearman, (max(x) - max(y)) / abs(max(y)) max_relative, {HIGH} FROM ranked GROUP BY pair"
    ),
    "pair n:i mae:d rms:d nrms:d max_difference:d pearson:d spearman:d max_relative:d p90_relative:d p95_relative:d p97_5_relative:d p99_relative:d",
)
def field_comparison(spark, sf):
    m = cut(_mean(spark, sf).select("volume", "iz", "iy", "ix", "v_mean"))
    a, b = m.select("iz", "iy", "ix", F.col("volume").alias("p"), F.col("v_mean").alias("x")), m.select("iz", "iy", "ix", F.col("volume").alias("q"), F.col("v_mean").alias("y"))
    both = a.join(b, ["iz", "iy", "ix"]).filter("p < q").withColumn("pair", F.concat_ws("-", "p", "q"))
    return vortex.compare(both, ["pair"], "x", "y")


MATCH = [
    "RECURSIVE " + FIELD, TIMES, MEAN, SW, SG, ACT, REACH,
    """found AS (SELECT volume, row_number() OVER (PARTITION BY volume ORDER BY root) AS component, integral, px, py, pz FROM (SELECT volume, root, sum(s) AS integral, sum(s * ix) / sum(s) AS px, sum(s * iy) / sum(s) AS py,
 sum(s * iz) / sum(s) AS pz FROM act JOIN (SELECT volume, c, min(r) AS root FROM reach GROUP BY ALL) USING (volume, c) GROUP BY ALL))""",
    """strong AS (SELECT p.volume || '-' || q.volume AS pair, f.*, row_number() OVER (PARTITION BY p.volume, q.volume ORDER BY CAST(integral AS FLOAT) DESC, component) AS place FROM (SELECT DISTINCT volume FROM found) p
 JOIN (SELECT DISTINCT volume FROM found) q ON p.volume < q.volume JOIN found f ON f.volume = p.volume)""",
    """greedy AS (SELECT DISTINCT pair, CAST(0 AS BIGINT) AS place, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS a_component, CAST(NULL AS BIGINT) AS b_component, CAST(NULL AS DOUBLE) AS distance FROM strong
 UNION ALL SELECT * FROM (SELECT s.pair, s.place, list_append(g.used, CAST(b.component AS BIGINT)) AS used, CAST(s.component AS BIGINT) AS a_component, CAST(b.component AS BIGINT) AS b_component, sqrt(pow(s.px - b.px, 2) + pow(s.py - b.py, 2) + pow(s.pz - b.pz, 2)) AS distance
 FROM greedy g JOIN strong s ON s.pair = g.pair AND s.place = g.place + 1 JOIN found b ON b.volume = split_part(s.pair, '-', 2) AND NOT list_contains(g.used, CAST(b.component AS BIGINT)))
 QUALIFY row_number() OVER (PARTITION BY pair ORDER BY distance, b_component) = 1)""",
]


@query("component_matching", MATCH, "SELECT pair, a_component, b_component, distance FROM greedy WHERE a_component IS NOT NULL", "pair a_component:i b_component:i distance:d")
def component_matching(spark, sf):
    found = cut(vortex.component_stats(vortex.label(_active(spark, sf), ["volume"]), ["volume"], "s"))
    names = found.select(F.col("volume").alias("p")).distinct()
    pairs = cut(names.join(names.withColumnRenamed("p", "q"), F.col("p") < F.col("q")).withColumn("pair", F.concat_ws("-", "p", "q")))  # of volumes
    a, b = (cut(found.join(pairs.select("pair", F.col(side).alias("volume")), "volume")) for side in "pq")
    return vortex.match_greedily(a, b, ["pair"])
