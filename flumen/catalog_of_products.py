"""Queries of products and cases over the general tables: planes of what operators have written, fields on another one's
planes, frequencies and speeds of cases; each with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog_of_queries import BINS, FIELD, HARM, PH, TIMES, M, _averages, _mean, query
from .operators import phase, stats
from .plans import cases
from .sources import fields, products
from .sources.fields import lineitem_field

PLACE = 'volume axis "index":i value:d horizontal_axis vertical_axis horizontal:d vertical:d'
COUNTS = "u_count:i v_count:i w_count:i"
SPEED = "sqrt(u * u + v * v + w * w) speed"


@query("mean_plane", M, f"""SELECT *, {SPEED}, u vector_horizontal, w vector_vertical FROM (SELECT volume, 'y' axis, iy "index", iy value, 'x' horizontal_axis, 'z' vertical_axis, ix horizontal, iz vertical,
 u_mean u, v_mean v, w_mean w, u_count, v_count, w_count FROM mean WHERE iy = 2)""", f"{PLACE} u:d v:d w:d {COUNTS} speed:d vector_horizontal:d vector_vertical:d")
def mean_plane(spark, sf):
    return products.mean_plane(_mean(spark, sf), "y", 2).drop("vector_count")


@query("inspector_mask", M, """SELECT volume, horizontal, vertical, speed, accepted, CASE WHEN accepted THEN u ELSE 0 END vector_horizontal, CASE WHEN accepted THEN v ELSE 0 END vector_vertical FROM (SELECT volume, ix / 2.0 horizontal, iy / 4.0 vertical, u_mean u, v_mean v,
 sqrt(u_mean * u_mean + v_mean * v_mean + w_mean * w_mean) speed, least(u_count, v_count, w_count) >= n_times / 20 accepted FROM mean WHERE iz = 3)""", "volume horizontal:d vertical:d speed:d accepted vector_horizontal:d vector_vertical:d")
def inspector_mask(spark, sf):
    """Each volume's own limit: a twentieth of its frames."""
    mean = _mean(spark, sf)
    half = fields.axes_of(mean, x="ix", y="iy", z="iz").withColumn("coord", F.col("coord") / F.when(F.col("axis") == "x", 2).otherwise(4))
    plane = products.mean_plane(mean, "z", -1, half).join(mean.select("volume", "n_times").distinct(), "volume")
    return products.displayed(plane, 2, F.col("n_times") / 20).select("volume", "horizontal", "vertical", "speed", "accepted", "vector_horizontal", "vector_vertical")


VECTORS_OF = ", ".join(f"max(CASE WHEN component = '{c}' THEN x END) {c}, max(CASE WHEN component = '{c}' THEN phase_count END) {c}_count" for c in "uvw")


@query("phase_plane", PH, f"""SELECT *, {SPEED}, v vector_horizontal, w vector_vertical, {BINS - 0.5} * 2 * pi() / {BINS} phase, {BINS - 0.5} * 360 / {BINS} phase_degrees, 'coherent' field
 FROM (SELECT volume, 'x' axis, ix "index", ix value, 'y' horizontal_axis, 'z' vertical_axis, iy horizontal, iz vertical, phase_bin, max(bin_frames) bin_frames, {VECTORS_OF}
 FROM (SELECT *, phase_mean - mean x FROM averages WHERE ix = 3 AND phase_bin = {BINS - 1}) GROUP BY volume, iz, iy, ix, phase_bin)""", f"{PLACE} phase_bin:i u:d v:d w:d {COUNTS} bin_frames:i field phase:d phase_degrees:d speed:d vector_horizontal:d vector_vertical:d")
def phase_plane(spark, sf):
    return products.phase_plane(_averages(spark, sf), BINS, -1, "x", -5, "coherent")


@query("phase_series", PH, f"""SELECT *, (phase_bin + 0.5) * 2 * pi() / {BINS} phase, (phase_bin + 0.5) * 360 / {BINS} phase_degrees FROM (SELECT volume, iz, iy, ix, phase_bin, max(bin_frames) bin_frames, {VECTORS_OF}
 FROM (SELECT *, phase_mean x FROM averages WHERE iz = 1 AND iy = 2 AND ix = 3) GROUP BY volume, iz, iy, ix, phase_bin)""", f"volume iz:i iy:i ix:i phase_bin:i u:d v:d w:d {COUNTS} bin_frames:i phase:d phase_degrees:d")
def phase_series(spark, sf):
    return products.phase_series(_averages(spark, sf), BINS, 1, 2, 3)


@query("harmonic_plane", PH, f"""SELECT volume, 'z' axis, iz "index", iz value, 'x' horizontal_axis, 'y' vertical_axis, ix horizontal, iy vertical, component, 'r2' quantity, r2 "data" FROM ({HARM}) WHERE component = 'v' AND iz = 3""", f'{PLACE} component quantity "data":d')
def harmonic_plane(spark, sf):
    return products.harmonic_plane(phase.first_harmonic(_averages(spark, sf), BINS), "z", -1, "v", "r2")


@query("aligned_support", [FIELD, TIMES], """SELECT volume, idx iz, iy, ix, count(CASE WHEN ok THEN 1 END) n_valid, count(CASE WHEN ok AND fill THEN 1 END) n_filled, count(CASE WHEN ok THEN 1 END) / n_times fraction, avg(CASE WHEN ok THEN v END) v
 FROM (SELECT volume, ti, iy, ix, idx, count(*) = max(hi - lo) + 1 AND bool_and(isfinite(u)) ok, bool_or(filled) fill, sum(v * CASE WHEN iz = lo THEN 1 - wt ELSE wt END) v
 FROM (SELECT volume, ti, iz, iy, ix, avg(u) u, avg(v) v, bool_or(filled) filled FROM field GROUP BY ALL) g JOIN (VALUES (0, 0, 1, 0.5), (1, 2, 3, 0.25), (2, 1, 1, 0)) s(idx, lo, hi, wt) ON g.iz = s.lo OR g.iz = s.hi GROUP BY volume, ti, iy, ix, idx)
 JOIN times USING (volume) GROUP BY volume, idx, iy, ix, n_times""", "volume iz:i iy:i ix:i n_valid:i n_filled:i fraction:d v:d")
def aligned_support(spark, sf):
    """Repeated samples are averaged first; a plane between two, one nearer to the lower one, and one that is there."""
    f = lineitem_field(spark, sf)
    g = f.groupBy("volume", "ti", "t", "iz", "iy", "ix").agg(*(F.avg(c).alias(c) for c in ("u", "v", "w")), F.bool_or("filled").alias("filled")).withColumn("z", F.col("iz").cast("double"))
    targets = f.select("volume").distinct().crossJoin(spark.createDataFrame([(0, 0.5), (1, 2.25), (2, 1.0)], "idx int, z double"))
    out = cases.aligned(g, targets)
    more = out.groupBy("volume", "iz", "iy", "ix").agg(F.count_if("filled").alias("n_filled"), F.avg("v").alias("v"))
    return cases.valid_fraction(out, stats.n_times(f)).join(more, ["volume", "iz", "iy", "ix"]).drop("n_times")


CASES = [
    """cases AS (SELECT CAST(c_custkey AS VARCHAR) case_id, CASE c_nationkey % 5 WHEN 0 THEN 'Rig_STATIC-2' WHEN 1 THEN 'low' WHEN 2 THEN 'high' WHEN 3 THEN 'idle' ELSE 'ecstatic' END label, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Static' ELSE 'surge' END motion_type,
 CASE WHEN c_custkey % 7 = 0 THEN 2.0 WHEN c_custkey % 7 IN (1, 2) THEN floor(c_acctbal / 1000) END stored FROM customer)""",
    "adjacent AS (SELECT CAST(o_custkey AS VARCHAR) case_id, min(f) lo, max(f) hi FROM (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 2.0 WHEN 'O' THEN 5.0 END f FROM orders WHERE o_orderkey % 4 = 1 OR o_orderstatus = 'P') GROUP BY ALL)",
]
RULE = "CASE WHEN motion_type = 'Static' OR label = 'Rig_STATIC-2' THEN {} WHEN stored > 0 AND label = 'low' AND stored <> 2 OR stored > 0 AND label = 'high' AND stored <> 5 THEN {} WHEN stored > 0 THEN {} WHEN label IN ('low', 'high', 'idle') THEN {} WHEN lo = hi THEN {} WHEN lo < hi THEN {} ELSE {} END"


@query("case_frequencies", CASES, "SELECT case_id, " + ", ".join((
    RULE.format("NULL", "NULL", "stored", "CASE label WHEN 'low' THEN 2.0 WHEN 'high' THEN 5.0 END", "lo", "NULL", "NULL") + " frequency",
    RULE.format("'static'", "'none'", "'stored'", "'known'", "'adjacent'", "'none'", "'none'") + " source",
    RULE.format("NULL", "'stored and known frequency differ'", "NULL", "NULL", "NULL", "'several frequencies beside it'", "NULL") + " error",
)) + " FROM cases LEFT JOIN adjacent USING (case_id)", "case_id frequency:d source error")
def case_frequencies(spark, sf):
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    label = F.element_at(F.array(*map(F.lit, ("Rig_STATIC-2", "low", "high", "idle", "ecstatic"))), (F.col("c_nationkey") % 5 + 1).cast("int"))
    turn = F.col("c_custkey") % 7
    stored = F.when(turn == 0, 2.0).when(turn.isin(1, 2), F.floor(F.col("c_acctbal") / 1000).cast("double"))
    table = read("customer").select(F.col("c_custkey").cast("string").alias("case_id"), label.alias("label"), F.when(F.col("c_mktsegment") == "MACHINERY", "Static").otherwise("surge").alias("motion_type"), stored.alias("stored"))
    status = F.col("o_orderstatus")
    beside = read("orders").filter((F.col("o_orderkey") % 4 == 1) | (status == "P")).select(F.col("o_custkey").cast("string").alias("case_id"), F.when(status == "F", 2.0).when(status == "O", 5.0).otherwise(-1.0).alias("frequency"))
    known = spark.createDataFrame([("low", 2.0), ("high", 5.0), ("idle", None)], "label string, frequency double")
    return products.resolved_frequency(table, known, beside)


@query("case_means", [*M, "speeds AS (SELECT l_returnflag AS volume, avg(l_quantity) + count(*) % 3 AS u_inf FROM lineitem GROUP BY l_returnflag)"], (
    "SELECT volume, iz, iy, ix, u_mean, u_mean / u_inf u_over_u_inf, (u_inf - u_mean) / u_inf wake_deficit, coalesce(u_mean / u_inf < 0.9, false) wake_mask_u09 FROM mean JOIN speeds USING (volume)"
), "volume iz:i iy:i ix:i u_mean:d u_over_u_inf:d wake_deficit:d wake_mask_u09")
def case_means(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    table = lines.groupBy(F.col("l_returnflag").alias("case_id")).agg((F.avg("l_quantity") + F.count("*") % 3).alias("u_inf"))
    runs = cases.CaseRuns(lineitem_field(spark, sf), table)
    return runs.mean().select("volume", "iz", "iy", "ix", "u_mean", "u_over_u_inf", "wake_deficit", "wake_mask_u09")
