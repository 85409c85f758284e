"""Queries of surfaces, components and compared fields over the general tables, each with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog_of_queries import FIELD, SG, SW, M, _mean, _swirl, query
from .operators import exports, precision, surface, vortex
from .plans import batches
from .plans.lineage import cut
from .sources import fields
from .sources.fields import VOXEL, lineitem_field

# Isosurfaces: the number of triangles of a case follows from the regions on its cube's faces. Where m loops cross e
# edges there are e - 2 m triangles, and m + 1 regions: inside corners by edges, outside ones across faces as well.

LEVEL = 53.0
CORNER = [(k & 1, k >> 1 & 1, k >> 2) for k in range(8)]
SIDES = [(k, k | 1 << a) for a in range(3) for k in range(8) if not k >> a & 1]
CASES = [
    "corner AS (SELECT c, k, (c >> k) & 1 = 1 AS inside FROM (SELECT unnest(range(256)) AS c), (SELECT unnest(range(8)) AS k))",
    """touch AS (SELECT a.c, a.k AS a, b.k AS b FROM corner a JOIN corner b ON a.c = b.c AND a.inside = b.inside AND (bit_count(xor(a.k, b.k)) = 1
 OR NOT a.inside AND bit_count(xor(a.k, b.k)) = 2 AND (a.c >> xor(a.k, xor(a.k, b.k) & -xor(a.k, b.k))) & 1 = 1 AND (a.c >> xor(b.k, xor(a.k, b.k) & -xor(a.k, b.k))) & 1 = 1))""",
    "region AS (SELECT c, k, k AS r FROM corner UNION SELECT t.c, t.b, g.r FROM region g JOIN touch t ON t.c = g.c AND t.a = g.k)",
    "regions AS (SELECT c, count(DISTINCT r) AS n FROM (SELECT c, k, min(r) AS r FROM region GROUP BY ALL) GROUP BY c)",
    f"crossed AS (SELECT c, {' + '.join(f'(xor(c >> {a}, c >> {b}) & 1)' for a, b in SIDES)} AS e FROM (SELECT unnest(range(256)) AS c))",
]
CELLS = [
    *M, *CASES,
    "cube AS (SELECT m0.volume, m0.iz, m0.iy, m0.ix, "
    + " + ".join(f"CASE WHEN m{k}.v_mean >= {LEVEL} THEN {1 << k} ELSE 0 END" for k in range(8))
    + ' AS "case", '
    + ", ".join(f"m{k}.v_mean AS v{k}" for k in range(8))
    + " FROM mean m0 "
    + " ".join(f"JOIN mean m{k} ON m{k}.volume = m0.volume AND m{k}.ix = m0.ix + {x} AND m{k}.iy = m0.iy + {y} AND m{k}.iz = m0.iz + {z}" for k, (x, y, z) in enumerate(CORNER) if k)
    + ")",
    'cut AS (SELECT cube.*, e - 2 * (n - 1) AS n FROM cube JOIN regions ON regions.c = "case" JOIN crossed ON crossed.c = "case" WHERE "case" > 0 AND "case" < 255)',
    "point AS ("
    + " UNION ".join(
        f"SELECT volume, ix + {CORNER[a][0]} + {s if b - a == 1 else 0} AS x, iy + {CORNER[a][1]} + {s if b - a == 2 else 0} AS y, iz + {CORNER[a][2]} + {s if b - a == 4 else 0} AS z, "
        f"{a ^ b} AS axis, ix + {CORNER[a][0]} AS px, iy + {CORNER[a][1]} AS py, iz + {CORNER[a][2]} AS pz FROM cut WHERE (v{a} >= {LEVEL}) <> (v{b} >= {LEVEL})"
        for a, b in SIDES
        for s in [f"({LEVEL} - v{a}) / (v{b} - v{a})"]
    )
    + ")",
]


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return surface.cells(_mean(spark, sf).select(*VOXEL, "v_mean"), ["volume"], "v_mean", LEVEL)


RECURSIVE = ["RECURSIVE " + CELLS[0], *CELLS[1:]]


@query("isosurface_cells", RECURSIVE, 'SELECT volume, iz, iy, ix, "case", n FROM cut', 'volume iz:i iy:i ix:i "case":i n:i')
def isosurface_cells(spark, sf):
    cells = _cells(spark, sf)
    n = surface.mesh(cells, ["volume"], LEVEL).groupBy(*VOXEL).agg(F.count("*").alias("n"))
    return cells.join(n, VOXEL).select(*VOXEL, "case", "n")


@query(
    "isosurface_mesh", RECURSIVE,
    (
        "SELECT * FROM (SELECT volume, count(*) AS vertices, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM (SELECT DISTINCT ON (volume, axis, px, py, pz) * FROM point) GROUP BY volume) "
        "JOIN (SELECT volume, sum(n) AS triangles FROM cut GROUP BY volume) USING (volume)"
    ),
    "volume vertices:i triangles:i x:d y:d z:d",
)
def isosurface_mesh(spark, sf):
    triangles = surface.mesh(_cells(spark, sf), ["volume"], LEVEL)
    points = surface.vertices(triangles, ["volume"]).groupBy("volume").agg(F.count("*").alias("vertices"), *(F.sum(a).alias(a) for a in "xyz"))
    return points.join(triangles.groupBy("volume").agg(F.count("*").alias("triangles")), "volume").select("volume", "vertices", "triangles", "x", "y", "z")


# Two recordings of one field: the second is rounded, lacks some samples, and its grid is shifted by a little

PAIRED = [
    FIELD,
    'a AS (SELECT * FROM field WHERE abs(ix - 4) <= 2.5), b AS (SELECT volume, ti, "row", iz, iy, ix, u + 0 AS u, round(v, 1) AS v, w * 1.5 AS w FROM field WHERE abs(ix - 4) <= 2.5 AND "row" % 7 <> 2)',
    "la AS (" + " UNION ALL ".join(f"SELECT '{c}' AS component, volume, ti, \"row\", iz, iy, ix, CASE WHEN isfinite({c}) THEN {c} END AS x FROM a" for c in "uvw") + ")",
    "lb AS (" + " UNION ALL ".join(f"SELECT '{c}' AS component, volume, ti, \"row\", iz, iy, ix, CASE WHEN isfinite({c}) THEN {c} END AS x FROM b" for c in "uvw") + ")",
    *(f"s{t} AS (SELECT component, iz, iy, ix, avg(x) AS m, var_pop(x) AS v, count(x) AS n FROM l{t} GROUP BY ALL)" for t in "ab"),
    "vox AS (SELECT component, iz, iy, ix, sa.m AS ma, sb.m AS mb, sa.v AS va, sb.v AS vb, sa.n AS na, sb.n AS nb FROM sa JOIN sb USING (component, iz, iy, ix))",
    'met AS (SELECT component, la.x - ma AS x, abs((la.x - ma) - (lb.x - mb)) AS d FROM la JOIN lb USING (component, volume, ti, "row", iz, iy, ix) JOIN vox USING (component, iz, iy, ix) WHERE la.x IS NOT NULL AND lb.x IS NOT NULL)',
    "tke AS (SELECT sum(va) / 2 AS ka, sum(vb) / 2 AS kb FROM vox GROUP BY iz, iy, ix)",
    """each AS (SELECT component, 'fluctuation' AS quantity, d FROM met UNION ALL SELECT component, 'variance', abs(va - vb) FROM vox UNION ALL SELECT 'tke', 'variance', abs(ka - kb) FROM tke UNION ALL SELECT component, 'count', CAST(abs(na - nb) AS DOUBLE) FROM vox)""",
    "scales AS (SELECT component, 'fluctuation' AS quantity, sqrt(avg(x * x)) AS scale FROM met GROUP BY component UNION ALL SELECT component, 'variance', avg(va) FROM vox GROUP BY component UNION ALL SELECT 'tke', 'variance', avg(ka) FROM tke UNION ALL SELECT component, 'count', avg(na) FROM vox GROUP BY component)",
]
STATS = {"mean": "avg(d)", "p95": "quantile_cont(d, 0.95)", "p99": "quantile_cont(d, 0.99)", "max": "max(d)"}


@query(
    "precision_pairs", PAIRED,
    "SELECT component, quantity, count(*) n, " + ", ".join(f'{s} AS "{k}"' for k, s in STATS.items()) + ", " + ", ".join(f"{s} / any_value(scale) AS {k}_relative" for k, s in STATS.items()) + " FROM each JOIN scales USING (component, quantity) GROUP BY ALL",
    'component quantity n:i mean:d p95:d p99:d "max":d mean_relative:d p95_relative:d p99_relative:d max_relative:d',
)
def precision_pairs(spark, sf):
    field = lineitem_field(spark, sf)
    other = field.filter(F.col("row") % 7 != 2).withColumns({"v": F.round("v", 1), "w": F.col("w") * 1.5, "ix": F.col("ix") + 10})
    axes = lambda t, shift: fields.axes_of(t.withColumns({"zz": F.col("iz") + shift, "yy": F.col("iy") - shift, "xx": F.col("ix") + shift}), z="zz", y="yy", x="xx").select("axis", "idx", "coord").distinct()
    shifted = axes(other, 0.004).withColumn("coord", F.col("coord") - F.when(F.col("axis") == "x", 10).otherwise(0))
    return precision.compare(field, other, axes(field, 0.0), shifted, 1e-2, {"x": (4.0, 2.5)}, sample=["volume", "ti", "row"])[0]


# A fine and a coarse export: every second plane in x, shifted, stronger

D, V = 30.0, 50.0
SCALE = D * D / (V * V)
LEVELS = " UNION ALL ".join([f"SELECT side, volume, 'max_{round(100 * s)}' AS kind, max(s) * {s} AS level FROM ex WHERE s > 0 GROUP BY ALL" for s in vortex.SHARES] + [f"SELECT side, volume, 'p{p * 100:g}', quantile_cont(s, {p}) FROM ex WHERE s > 0 GROUP BY ALL" for p in vortex.PERCENTILES])
RELATIVE = "quantile_cont(c, 0.99) / nullif(quantile_cont(f, 0.99), 0) - 1"
EXPORTS = [
    "RECURSIVE " + FIELD, *M[1:], SW, SG,
    f"""ex AS (SELECT 'fine' AS side, volume, iz, iy, ix AS i, CAST(ix AS DOUBLE) AS x, s * {SCALE} AS s, 1e0 AS cv, 1e0 AS typical FROM signed
 UNION ALL SELECT 'coarse', volume, iz, iy, CAST((ix - 1) / 2 AS INTEGER), ix + 0.25, s * (1 + iy * 0.2) * {SCALE}, 2e0, 4 / 3e0 FROM signed WHERE ix % 2 = 1)""",
    f"levels AS ({LEVELS})",
    "act AS (SELECT side, volume, kind, iz, iy, i, x, s, cv, typical, (i * 100 + iy) * 100 + iz AS c FROM ex JOIN levels USING (side, volume) WHERE s >= level)",
    "reach AS (SELECT side, volume, kind, c, c AS r FROM act UNION SELECT b.side, b.volume, b.kind, b.c, p.r FROM reach p JOIN act a USING (side, volume, kind, c) JOIN act b ON b.side = a.side AND b.volume = a.volume AND b.kind = a.kind AND abs(a.i - b.i) + abs(a.iy - b.iy) + abs(a.iz - b.iz) = 1)",
    """found AS (SELECT side, volume, kind, row_number() OVER (PARTITION BY side, volume, kind ORDER BY root) AS component, sum_s * cv AS integral, px, py, pz, pow(6 * n * cv / pi(), 1 / 3.0) / typical AS core
 FROM (SELECT side, volume, kind, root, count(*) AS n, sum(s) AS sum_s, sum(s * x) / sum(s) AS px, sum(s * iy) / sum(s) AS py, sum(s * iz) / sum(s) AS pz, any_value(cv) AS cv, any_value(typical) AS typical
 FROM act JOIN (SELECT side, volume, kind, c, min(r) AS root FROM reach GROUP BY ALL) USING (side, volume, kind, c) GROUP BY ALL))""",
    "strong AS (SELECT *, row_number() OVER (PARTITION BY volume, kind ORDER BY CAST(integral AS FLOAT) DESC, component) AS place FROM found WHERE side = 'fine')",
    """greedy AS (SELECT DISTINCT volume, kind, CAST(0 AS BIGINT) AS place, CAST([] AS BIGINT[]) AS used, CAST(NULL AS DOUBLE) AS distance FROM strong
 UNION ALL SELECT volume, kind, place, used, distance FROM (SELECT s.volume, s.kind, s.place, list_append(g.used, CAST(b.component AS BIGINT)) AS used, b.component, sqrt(pow(s.px - b.px, 2) + pow(s.py - b.py, 2) + pow(s.pz - b.pz, 2)) AS distance
 FROM greedy g JOIN strong s ON s.volume = g.volume AND s.kind = g.kind AND s.place = g.place + 1 JOIN found b ON b.side = 'coarse' AND b.volume = g.volume AND b.kind = g.kind AND NOT list_contains(g.used, CAST(b.component AS BIGINT)))
 QUALIFY row_number() OVER (PARTITION BY volume, kind ORDER BY distance, component) = 1)""",
    "pairs AS (SELECT c.volume, c.s AS c, 0.75 * a.s + 0.25 * b.s AS f FROM ex c JOIN ex a ON c.side = 'coarse' AND a.side = 'fine' AND a.volume = c.volume AND a.iz = c.iz AND a.iy = c.iy AND a.x = c.x - 0.25 JOIN ex b ON b.side = 'fine' AND b.volume = c.volume AND b.iz = c.iz AND b.iy = c.iy AND b.x = c.x + 0.75)",
    f"measures AS (SELECT volume, 2 / {D} AS spacing, sqrt(avg((c - f) * (c - f))) / sqrt(avg(f * f)) AS nrms, corr(c, f) AS pearson, {RELATIVE} AS p99_relative FROM pairs WHERE c IS NOT NULL AND f IS NOT NULL GROUP BY volume)",
    "more AS (SELECT * FROM measures JOIN (SELECT volume, median(distance) AS displacement FROM greedy WHERE distance IS NOT NULL GROUP BY volume) USING (volume) JOIN (SELECT volume, median(core) AS core FROM found WHERE side = 'coarse' GROUP BY volume) USING (volume))",
    f"""points AS (SELECT *, CASE WHEN spacing > 0.08 THEN 2 WHEN spacing > 0.04 THEN 1 ELSE 0 END AS p1, CASE WHEN nrms > 0.35 THEN 2 WHEN nrms > 0.2 THEN 1 ELSE 0 END AS p2, CASE WHEN pearson < 0.75 THEN 2 WHEN pearson < 0.9 THEN 1 ELSE 0 END AS p3,
 CASE WHEN abs(p99_relative) > 0.35 THEN 1 ELSE 0 END AS p4, CASE WHEN displacement > 0.05 * {D} THEN 1 ELSE 0 END AS p5, CASE WHEN core < 4 THEN 2 WHEN core < 6 THEN 1 ELSE 0 END AS p6 FROM more)""",
]
NAMED = ("grid spacing", "normalised RMS error", "correlation", "99th percentile", "displacement of centres", "cells across a core")


@query(
    "export_verdict", EXPORTS,
    "SELECT volume, spacing, nrms, pearson, p99_relative, displacement, core, p1 + p2 + p3 + p4 + p5 + p6 AS score, CASE WHEN p1 + p2 + p3 + p4 + p5 + p6 >= 5 THEN 'too coarse' WHEN p1 + p2 + p3 + p4 + p5 + p6 >= 2 THEN 'qualitative' ELSE 'quantitative' END AS verdict, concat_ws('; ', "
    + ", ".join(f"CASE WHEN p{i + 1} > 0 THEN '{n}' END" for i, n in enumerate(NAMED)) + ") AS reasons FROM points",
    "volume spacing:d nrms:d pearson:d p99_relative:d displacement:d core:d score:i verdict reasons",
)
def export_verdict(spark, sf):
    s = cut(_swirl(spark, sf))
    points = s.select("volume", *(F.col(f"i{a}").cast("double").alias(a) for a in "xyz"), F.col("s").alias("swirl"))
    coarse = points.filter("x % 2 = 1").select("volume", (F.col("x") + 0.25).alias("x"), "y", "z", (F.col("swirl") * (1 + F.col("y") * 0.2)).alias("swirl"))
    found = exports.compare_exports(points, coarse, D, V)["verdict"]
    return found.withColumn("reasons", F.concat_ws("; ", "reasons"))


# Decompositions of several volumes at once; one of them has a single snapshot and fails

BATCH = [
    FIELD,
    "cells AS (SELECT volume, CAST(floor(ti / 100) AS INTEGER) AS snapshot, iz, iy, ix, avg(v) AS value FROM field GROUP BY ALL), snaps AS (SELECT * FROM cells UNION ALL SELECT 'one', snapshot, iz, iy, ix, value FROM cells WHERE volume = 'A' AND snapshot = 20)",
    "size AS (SELECT volume, count(DISTINCT snapshot) AS n FROM snaps GROUP BY volume)",
    "kept AS (SELECT volume, iz, iy, ix, avg(value) AS m FROM snaps JOIN size USING (volume) GROUP BY volume, iz, iy, ix, n HAVING count(*) >= ceil(0.9 * n))",
    "sums AS (SELECT volume, count(DISTINCT (iz, iy, ix)) AS n_dofs, sum((value - m) * (value - m)) / any_value(n) / 2 AS energy FROM snaps JOIN kept USING (volume, iz, iy, ix) JOIN size USING (volume) GROUP BY volume)",
]


@query(
    "batch_energy", BATCH,
    "SELECT volume, n_snapshots, n_dofs, CASE WHEN reason IS NULL THEN 'processed' ELSE 'failed' END AS status, reason, CASE WHEN reason IS NULL THEN energy END AS energy FROM (SELECT volume, n AS n_snapshots, coalesce(n_dofs, 0) AS n_dofs, energy, "
    "CASE WHEN n < 2 THEN 'fewer than two snapshots' WHEN n_dofs IS NULL THEN 'nothing with enough snapshots' END AS reason FROM size LEFT JOIN sums USING (volume))",
    "volume n_snapshots:i n_dofs:i status reason energy:d",
)
def batch_energy(spark, sf):
    cells = lineitem_field(spark, sf).groupBy("volume", F.floor(F.col("ti") / 100).cast("int").alias("snapshot"), F.concat_ws(",", "iz", "iy", "ix").alias("dof")).agg(F.avg("v").alias("value"))
    one = cells.filter("volume = 'A' and snapshot = 20").withColumn("volume", F.lit("one"))
    found = batches.decompose_volumes(cells.unionByName(one), 1000, 0.9)
    energy = found["spectra"].groupBy("volume").agg(F.sum("energy").alias("energy"))
    return found["status"].join(energy, "volume", "left").select("volume", "n_snapshots", "n_dofs", "status", "reason", "energy")
