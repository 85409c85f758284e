"""Vortex fields: masks, thresholds, connected components, comparison."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..functions.validity import finite
from ..plans.lineage import cut, held
from ..plans.order import running, unused
from ..plans.quantile import with_quantiles
from ..plans.tiles import SIZE, by_tile

SHARES, PERCENTILES = (0.2, 0.3, 0.4), (0.9, 0.95, 0.975, 0.99)
#: Spellings of column names, in lower case, without marks, ^2 as 2.
ALIASES = {
    "x": ("x", "coordx", "positionx", "posx", "xcoordinate", "coordinatex", "xcoord", "xm", "xmm"),
    "y": ("y", "coordy", "positiony", "posy", "ycoordinate", "coordinatey", "ycoord", "ym", "ymm"),
    "z": ("z", "coordz", "positionz", "posz", "zcoordinate", "coordinatez", "zcoord", "zm", "zmm"),
    "swirl": ("lambdacisquared", "lambdaci2", "lambdacisq", "lambdaci", "lambdasquared", "swirlingstrengthsquared", "swir", "swirl2", "swirling2", "lambda2", "lambda", "swirlingstrength2", "swirl"),
    "u": ("u", "ux", "velocityu", "velocityx", "uvelocity", "vx"),
    "v": ("v", "uy", "velocityv", "velocityy", "vvelocity", "vy"),
    "w": ("w", "uz", "velocityw", "velocityz", "wvelocity", "vz"),
}


def infer_columns(names: list[str]) -> dict[str, str]:
    """Which column is which quantity, from common spellings; x, y, z and swirl are needed."""
    plain = {"".join(c for c in n.lower().replace("^2", "2") if c.isalnum()): n for n in reversed(names)}
    found = {k: plain[a] for k, spellings in ALIASES.items() for a in reversed(spellings) if a in plain}
    missing = {"x", "y", "z", "swirl"} - set(found)
    if missing:
        raise KeyError(f"no column for {sorted(missing)} among {names}")
    return found


def hole_mask(swirl: Column, components: list[Column], mode: str = "none") -> Column:
    """Swirl, null where the velocity says that there is no measurement: none, velocity-zero, velocity-nan,
    velocity-zero-or-nan."""
    zero = reduce(lambda a, c: a & (c == 0), components, F.lit(True))
    bad = reduce(lambda a, c: a | ~finite(c), components, F.lit(False))
    hole = {"none": F.lit(False), "velocity-zero": zero, "velocity-nan": bad, "velocity-zero-or-nan": zero | bad}[mode]
    return F.when(~F.coalesce(hole, F.lit(True)), swirl)


def signed(field: DataFrame, value: str, keys: list[str], sign: str = "auto") -> DataFrame:
    """The value turned round if asked for (negative) or if all there is is negative (auto); what stays negative is 0."""
    ok = F.when(finite(F.col(value)), F.col(value))
    ends = field.groupBy(*keys).agg(F.max(ok).alias("_hi"), F.min(ok).alias("_lo"))
    flip = {"auto": (F.col("_hi") <= 0) & (F.col("_lo") < 0), "negative": F.lit(True), "positive": F.lit(False)}[sign]
    out = field.join(ends, keys) if keys else field.crossJoin(F.broadcast(ends))
    return out.withColumn(value, F.greatest(F.when(flip, -F.col(value)).otherwise(F.col(value)), F.lit(0.0))).drop("_hi", "_lo")


def nondimensional(value: Column, diameter: float, u_inf: float) -> Column:
    return value * diameter * diameter / (u_inf * u_inf)


def inspect_grid(points: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Different coordinates along each axis, repeated and missing points, whether the grid is whole, share of NaN."""
    each = points.groupBy(*keys, "x", "y", "z").agg(F.count("*").alias("n"), F.count_if(~finite(F.col(value))).alias("bad"))
    out = each.groupBy(*keys).agg(F.count_distinct("x").alias("nx"), F.count_distinct("y").alias("ny"), F.count_distinct("z").alias("nz"), F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("repeated"), F.count("*").alias("distinct_points"), F.sum("bad").alias("bad"))
    missing = F.col("nx") * F.col("ny") * F.col("nz") - F.col("distinct_points")
    return out.select(*keys, "nx", "ny", "nz", "n", "repeated", missing.alias("missing"), ((missing == 0) & (F.col("repeated") == 0)).alias("structured"), (100.0 * F.col("bad") / F.col("n")).alias("bad_percent"))


def suitability(grid: DataFrame) -> DataFrame:
    """An additive score of what speaks against a grid by itself (few points along an axis, no whole grid, NaN), and the
    verdict. Whether an export will do beside a finer one is said by exports.verdict."""
    score = F.when(F.least("nx", "ny", "nz") < 3, 3).otherwise(0) + F.when(~F.col("structured"), 2).otherwise(0) + F.when(F.col("bad_percent") > 20, 2).when(F.col("bad_percent") > 5, 1).otherwise(0)
    return grid.withColumn("score", score).withColumn("verdict", F.when(F.col("score") >= 5, "too coarse").when(F.col("score") >= 2, "qualitative").otherwise("suitable"))


def _numbered(table: DataFrame, keys: list[str], by: str, sizes: dict[str, Column]) -> DataFrame:
    """table with running sums of sizes before each row, in the order of `by` within keys."""
    out = running(table, [*map(F.col, keys), F.col(by)], sizes)
    first = [F.min(n).alias(f"_{n}0") for n in sizes]
    ends = out.groupBy(*keys).agg(*first)
    out = out.join(ends, keys) if keys else out.crossJoin(F.broadcast(ends))  # a row, without keys
    return out.select(*table.columns, *((F.col(n) - F.col(f"_{n}0")).alias(n) for n in sizes))


def grid_indices(points: DataFrame, keys: list[str]) -> DataFrame:
    """points with ix, iy, iz: ranks of their coordinates. Ranks come from the axes, not from the points."""
    for a in ("x", "y", "z"):
        axis = _numbered(points.select(*keys, a).distinct(), keys, a, {f"i{a}": F.lit(1)})
        points = points.join(axis, [*keys, a])
    return points


def thresholds(field: DataFrame, keys: list[str], value: str) -> DataFrame:
    """kind and level: parts of the maximum and percentiles of positive finite values."""
    ok = F.when(finite(F.col(value)) & (F.col(value) > 0), F.col(value))
    by = with_quantiles(field.groupBy(*keys).agg(F.max(ok).alias("top")), field, keys, ok, list(PERCENTILES), "p")
    rows = [F.struct(F.lit(f"max_{round(s * 100)}").alias("kind"), (F.col("top") * s).alias("level")) for s in SHARES] + [F.struct(F.lit(f"p{p * 100:g}").alias("kind"), F.get("p", F.lit(i)).alias("level")) for i, p in enumerate(PERCENTILES)]
    return by.select(*keys, F.explode(F.array(*rows)).alias("t")).select(*keys, "t.*")


def _joined_parts(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, u, root for every u of the edges (both ways): the smallest it is connected with. Roots spread to neighbours
    and then jump along the roots found so far, so rounds grow with the logarithm of a component's length."""
    edges = held(edges)
    roots = held(edges.select(*keys, "u").distinct().withColumn("root", F.col("u")))
    while True:
        seen = edges.join(roots.select(*keys, F.col("u").alias("v"), "root"), [*keys, "v"]).groupBy(*keys, "u").agg(F.min("root").alias("m"))
        low = roots.select(*keys, "u", "root").join(seen, [*keys, "u"], "left").select(*keys, "u", F.least("root", F.coalesce("m", "root")).alias("root"), F.col("root").alias("old"))
        best = low.groupBy(*keys, F.col("old").alias("u")).agg(F.min("root").alias("hook"))
        step = low.join(best.withColumnRenamed("u", "old"), [*keys, "old"]).select(*keys, "u", F.least("root", "hook").alias("root"), "old")
        jump = step.select(*keys, F.col("u").alias("root"), F.col("root").alias("far"))
        new = held(step.join(jump, [*keys, "root"], "left").select(*keys, "u", F.least("root", F.coalesce("far", "root")).alias("root"), "old"))
        roots.unpersist()
        done = new.filter("root <> old").isEmpty()
        roots = new
        if done:
            edges.unpersist()
            return roots.select(*keys, "u", "root")


def _parts_of_tile(axes: tuple[str, ...], size: int):
    """Union-find over the active cells of one tile: each own cell's smallest connected one, and the active cells of other
    tiles that are next to it."""

    def work(origin: np.ndarray, columns: dict[str, np.ndarray], at: np.ndarray) -> dict:
        order = np.argsort(columns["cell"], kind="stable")
        at, cell = at[order], columns["cell"][order]
        own = (at < size).all(1)
        grid = np.full(np.minimum(at.max(0) + 1, size + 1), -1)
        grid[tuple(at.T)] = np.arange(len(at))
        low, high = [], []
        for i in range(len(axes)):
            step = at.copy()
            step[:, i] += 1
            inside = np.flatnonzero(own & (step < grid.shape).all(1))
            ahead = grid[tuple(step[inside].T)]
            low.append(inside[ahead >= 0])
            high.append(ahead[ahead >= 0])
        low, high = np.concatenate(low), np.concatenate(high)
        within = own[high]
        a, b, parent = low[within], high[within], np.arange(len(at))
        while True:
            p, q = parent[a], parent[b]
            if (p == q).all():
                break
            np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
            while not (parent[parent] == parent).all():
                parent = parent[parent]
        out: list[list[int] | None] = [None] * len(at)
        for u, v in zip(low[~within].tolist(), cell[high[~within]].tolist()):
            out[u] = [*(out[u] or []), v]
        mine = np.flatnonzero(own)
        return {"rows": order[mine], "part": cell[parent[mine]], "ahead": [out[i] for i in mine.tolist()]}

    return work


def label(cells: DataFrame, keys: list[str], axes: tuple[str, ...] = ("ix", "iy", "iz"), size: int = SIZE) -> DataFrame:
    """cells (one row for each active cell) with root: the smallest cell number of its component of face neighbours.

    Cells are joined to parts within tiles of the grid first, each tile by itself; only what borders another tile is left
    for joins between parts. So a component that fills the grid has a row for each tile in these, not for each cell.
    """
    spans = cells.groupBy(*keys).agg(*(f(a).alias(f"_{a}{k}") for a in axes for f, k in ((F.min, 0), (F.max, 1))))
    numbered = cells.join(spans, keys) if keys else cells.crossJoin(F.broadcast(spans))
    number, stride = F.lit(0).cast("long"), F.lit(1).cast("long")
    for a in reversed(axes):
        number = number + (F.col(a) - F.col(f"_{a}0")) * stride
        stride = stride * (F.col(f"_{a}1") - F.col(f"_{a}0") + 1)
    numbered = numbered.withColumn("cell", number).drop(*(f"_{a}{k}" for a in axes for k in (0, 1)))
    out = StructType([StructField("part", LongType()), StructField("ahead", ArrayType(LongType()))])
    carried = [c for c in numbered.columns if c not in keys]
    parts = cut(by_tile(numbered, keys, list(axes), ["cell"], _parts_of_tile(axes, size), out, size, carried))
    borders = parts.select(*keys, F.col("part").alias("u"), F.explode("ahead").alias("cell")).join(parts.select(*keys, "cell", F.col("part").alias("v")), [*keys, "cell"]).select(*keys, "u", "v").distinct()
    borders = cut(borders)
    parts = parts.drop("ahead")
    if borders.isEmpty():
        return parts.withColumnRenamed("part", "root")
    roots = _joined_parts(borders.unionByName(borders.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), keys)
    found = parts.join(roots.withColumnRenamed("u", "part"), [*keys, "part"], "left").withColumn("root", F.coalesce("root", "part")).drop("part")
    return cut(found)


def ends(field: DataFrame, keys: list[str], axes: tuple[str, ...] = ("ix", "iy", "iz")) -> DataFrame:
    """The first and last place of a grid along each axis: keys, <axis>_first, <axis>_last."""
    return field.groupBy(*keys).agg(*(f(a).alias(f"{a}_{n}") for a in axes for f, n in ((F.min, "first"), (F.max, "last"))))


def component_stats(labelled: DataFrame, keys: list[str], value: str, axes: tuple[str, ...] = ("ix", "iy", "iz"), cell_volume: float = 1.0, min_size: int = 1, grid: DataFrame | None = None, remove_boundary: bool = False, spacing: float = 1.0) -> DataFrame:
    """Size, centres, peak, integral, extent, equivalent diameter and cells across it (of a typical spacing) of each
    component of at least a size; ids follow the first cell in scan order, after what is left out. With the grid's ends
    each says whether it touches the boundary, and those that do can be removed. axes may be coordinates."""
    v = F.col(value)
    by = labelled.groupBy(*keys, "root").agg(
        F.count("*").alias("size"), *(F.avg(a).alias(f"{a}_centre") for a in axes), *(F.coalesce(F.try_divide(F.sum(F.col(a) * v), F.sum(v)), F.avg(a)).alias(f"{a}_weighted") for a in axes),
        *(f(a).alias(f"{a}_{n}") for a in axes for f, n in ((F.min, "min"), (F.max, "max"))), F.max(v).alias("peak"), F.max_by("cell", F.struct(v, -F.col("cell"))).alias("peak_cell"), (F.sum(v) * cell_volume).alias("integral"),
        *(F.max_by(a, F.struct(v, -F.col("cell"))).alias(f"{a}_peak") for a in axes),
    ).filter(F.col("size") >= min_size)
    if grid is not None:
        touches = reduce(lambda p, q: p | q, ((F.col(f"{a}_min") == F.col(f"{a}_first")) | (F.col(f"{a}_max") == F.col(f"{a}_last")) for a in axes))
        by = by.join(grid, keys) if keys else by.crossJoin(F.broadcast(grid))  # a row, without keys
        by = by.withColumn("touches_boundary", touches).drop(*(f"{a}_{n}" for a in axes for n in ("first", "last")))
        by = by.filter(~F.col("touches_boundary")) if remove_boundary else by
    elif remove_boundary:
        raise ValueError("the grid's ends are needed to say what touches its boundary")
    diameter = F.pow(6 * F.col("size") * cell_volume / math.pi, 1 / 3) if len(axes) == 3 else F.sqrt(4 * F.col("size") * cell_volume / math.pi)
    by = _numbered(by, keys, "root", {"component": F.lit(1)})
    return by.withColumns({"component": F.col("component") + 1, "diameter": diameter, "cells_across": diameter / spacing})


def ranked(field: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Average ranks of values by key, ties sharing theirs."""
    counts = _numbered(field.groupBy(*keys, value).agg(F.count("*").alias("_n")), keys, value, {"_before": F.col("_n")})
    ranks = counts.select(*keys, value, (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(out))
    return field.join(ranks, [*keys, value])


def compare(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Two fields on one grid: errors, correlation of values and of ranks, differences of maximum and high percentiles
    relative to b. Correlations need two values and variance."""
    good = pairs.filter(finite(F.col(a)) & finite(F.col(b)))
    good = cut(ranked(ranked(good, keys, a, "_ra"), keys, b, "_rb"))
    d = F.col(a) - F.col(b)
    rel = lambda x, y: F.try_divide(x - y, F.abs(y))
    corr = lambda x, y: F.when(F.count("*") >= 2, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
    m = good.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rms"), F.max(F.abs(d)).alias("max_difference"), F.sqrt(F.avg(F.col(b) * F.col(b))).alias("_s"),
        corr(a, b).alias("pearson"), corr("_ra", "_rb").alias("spearman"), F.max(a).alias("_ma"), F.max(b).alias("_mb"),
    )
    for c, name in ((a, "_pa"), (b, "_pb")):
        m = with_quantiles(m, good, keys, c, list(PERCENTILES), name)
    return m.select(*keys, "n", "mae", "rms", F.try_divide("rms", "_s").alias("nrms"), "max_difference", "pearson", "spearman", rel(F.col("_ma"), F.col("_mb")).alias("max_relative"), *(rel(F.get("_pa", F.lit(i)), F.get("_pb", F.lit(i))).alias(f"p{str(p * 100).rstrip('0').rstrip('.').replace('.', '_')}_relative") for i, p in enumerate(PERCENTILES)))


#: Components of a side of a key up to which one task matches the key.
MATCHED_AT_ONCE = 2_000
#: Distances are equal that agree to so many binary places of the largest coordinate: 1e-12 of it.
PLACES, TINY = 40, 1e-290


def match_greedily(a: DataFrame, b: DataFrame, keys: list[str], axes: tuple[str, ...] = ("ix", "iy", "iz"), most: int = MATCHED_AT_ONCE) -> DataFrame:
    """Components of a, the strongest first, each with the nearest one of b that is still free: a_component,
    b_component, distance by key, until either side is used up. Integrals that agree as single-precision numbers are equal
    (sums of equal values differ in their last digits from run to run); of those the first component goes first. So are
    distances that agree to PLACES, as centres come from such sums; of those the first component is the nearest. Keys with up to `most` components on either side are
    matched one by one, each in a task; larger ones in rounds of proposals."""
    own = keys or [unused(a, "_all", *b.columns)]
    a, b = (t.select(*([] if keys else [F.lit(0).alias(own[0])]), *keys, "component", *([F.col("integral").cast("float").cast("double").alias("integral")] if t is a else []), *(F.col(f"{x}_weighted").cast("double").alias(f"{x}_weighted") for x in axes)) for t in (a, b))
    a, b = cut(a), cut(b.select(*(F.col(c).alias(c) for c in b.columns)))  # both may come from one table
    a, b = (t.toDF(*t.columns) for t in (a, b))
    n = a.groupBy(*own).agg(F.count("*").alias("_na")).join(b.groupBy(*own).agg(F.count("*").alias("_nb")), own)
    n = cut(n.select(*own, ((F.col("_na") <= most) & (F.col("_nb") <= most)).alias("_small")))
    small, large = n.filter("_small").select(*own), n.filter("not _small").select(*own)
    kinds = {f.name: f.dataType for f in (*a.schema.fields, *(StructField(f"b_{f.name}", f.dataType) for f in b.schema.fields))}
    out = StructType([*(StructField(k, kinds[k]) for k in own), StructField("a_component", kinds["component"]), StructField("b_component", kinds["b_component"]), StructField("distance", DoubleType())])
    at = [f"{x}_weighted" for x in axes]

    def one_by_one(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by([("integral", "descending"), ("component", "ascending")]), right.sort_by("component")
        p, q = (np.stack([t[c].to_numpy() for c in at], 1) for t in (left, right))
        largest = max(np.abs(p).max(), np.abs(q).max(), TINY)
        unit = 2.0 ** (np.ceil(np.log2(largest)) - PLACES)
        free, pairs, far = np.ones(len(q), bool), [], []
        for i in range(min(len(p), len(q))):
            d = np.sqrt(((q - p[i]) ** 2).sum(1))
            j = int(np.argmin(np.where(free, np.rint(d / unit), np.inf)))
            free[j] = False
            pairs.append((i, j))
            far.append(float(d[j]))
        i, j = (pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1))
        return pa.table([*(left[k].take(i) for k in own), left["component"].take(i), right["component"].take(j), pa.array(far, pa.float64())], names=out.names)

    of = lambda t, which: t.join(which, own, "left_semi")
    done = of(a, small).groupBy(*own).cogroup(of(b, small).groupBy(*own)).applyInArrow(one_by_one, out)
    if not large.isEmpty():
        done = done.unionByName(_match_in_rounds(of(a, large), of(b, large), own, axes))
    return cut(done.select(*keys, "a_component", "b_component", "distance"))


def _match_in_rounds(a: DataFrame, b: DataFrame, keys: list[str], axes: tuple[str, ...]) -> DataFrame:
    """All of a that have none propose at once to the nearest of b that no stronger one holds; b keeps the strongest, who may
    drive out a weaker one, who proposes again. That ends with the pairs of the order one by one, as no component of b
    ever goes back to a weaker one. Proposals look at the cells around a component only, whose width starts with the mean
    distance in b and doubles for those that find nothing.
    """
    order = [*map(F.col, keys), F.col("integral").desc(), F.col("component")]
    left = running(a.select(*keys, "integral", "component", *(F.col(f"{x}_weighted").cast("double").alias(f"a_{x}") for x in axes)), order, {"rank": F.lit(1)})
    left = left.select(*keys, "rank", F.col("component").alias("a_component"), *(f"a_{x}" for x in axes))
    free = b.select(*keys, F.col("component").alias("b_component"), *(F.col(f"{x}_weighted").cast("double").alias(f"b_{x}") for x in axes))
    both = left.select(*keys, F.lit(0).alias("_b"), *(F.col(f"a_{x}").alias(x) for x in axes)).unionByName(free.select(*keys, F.lit(1).alias("_b"), *(F.col(f"b_{x}").alias(x) for x in axes)))
    span = reduce(F.greatest, (F.max(x) - F.min(x) for x in axes)) if len(axes) > 1 else F.max(axes[0]) - F.min(axes[0])
    largest = F.greatest(*(F.max(F.abs(x)) for x in axes), F.lit(TINY))
    unit = F.pow(F.lit(2.0), F.ceil(F.log2(largest)) - PLACES)
    size = both.groupBy(*keys).agg(F.greatest(span, F.lit(1e-300)).alias("_span"), unit.alias("_unit"), F.sum("_b").alias("_nb")).filter("_nb > 0")
    # A width is many units, so that what is within it is never taken for equal to what the cells miss.
    size = size.select(*keys, F.greatest(F.col("_span") / F.pow("_nb", 1 / len(axes)), F.col("_unit") * 2.0**20).alias("_width"), F.greatest("_span", F.col("_unit") * 2.0**20).alias("_span"), "_unit")
    add = lambda t: t.join(size, keys) if keys else t.crossJoin(F.broadcast(size))
    active = held(add(left).withColumn("_level", F.lit(0)))
    there = held(add(free))
    holders = held(there.select(*keys, "b_component", F.lit(None).cast("long").alias("holder"), F.lit(None).cast("double").alias("distance")))
    place = lambda p, x: F.floor(F.col(f"{p}_{x}") / (F.col("_width") * F.pow(F.lit(2.0), F.col("_level")))).cast("long")
    distance = F.sqrt(reduce(lambda s, x: s + F.pow(F.col(f"a_{x}") - F.col(f"b_{x}"), 2), axes, F.lit(0.0)))
    ranks = cut(left)
    while not active.isEmpty():
        first = active.groupBy(*keys).agg(F.min("rank").alias("_first"), F.collect_set("_level").alias("_levels"))
        # Only those of b that some of the active ones may still have, at the widths that are looked at.
        open_ = there.join(holders.select(*keys, "b_component", "holder"), [*keys, "b_component"])
        open_ = (open_.join(first, keys) if keys else open_.crossJoin(F.broadcast(first))).filter(F.col("holder").isNull() | (F.col("holder") > F.col("_first")))
        open_ = open_.withColumn("_level", F.explode("_levels")).withColumns({f"_c{x}": place("b", x) for x in axes}).select(*keys, "_level", "b_component", "holder", *(f"b_{x}" for x in axes), *(f"_c{x}" for x in axes))
        near = active
        for x in axes:
            near = near.withColumn(f"_c{x}", F.explode(F.array(*(place("a", x) + k for k in (-1, 0, 1)))))
        met = near.join(open_, [*keys, "_level", *(f"_c{x}" for x in axes)]).withColumn("distance", distance)
        # Within the width of a cell nothing is missed; a little less of it leaves no tie with what lies just beyond.
        met = met.filter((F.col("holder").isNull() | (F.col("holder") > F.col("rank"))) & (F.col("distance") <= F.col("_width") * F.pow(F.lit(2.0), F.col("_level")) * (1 - 2.0**-16)))
        best = cut(met.groupBy(*keys, "rank").agg(F.min(F.struct(F.rint(F.col("distance") / F.col("_unit")).alias("_d"), "b_component", "distance")).alias("m")).select(*keys, "rank", "m.b_component", "m.distance"))
        claims = best.unionByName(holders.filter("holder is not null").select(*keys, F.col("holder").alias("rank"), "b_component", "distance"))
        won = claims.groupBy(*keys, "b_component").agg(F.min(F.struct("rank", "distance")).alias("w")).select(*keys, "b_component", F.col("w.rank").alias("holder"), F.col("w.distance").alias("distance"))
        new = held(holders.select(*keys, "b_component").join(won, [*keys, "b_component"], "left"))
        held_by = lambda t: t.filter("holder is not null").select(*keys, F.col("holder").alias("rank"))
        out = ranks.join(active.select(*keys, "rank").unionByName(held_by(holders)), [*keys, "rank"], "left_semi").join(held_by(new), [*keys, "rank"], "left_anti")
        levels = active.select(*keys, "rank", "_level").join(best.select(*keys, "rank", F.lit(1).alias("_found")), [*keys, "rank"], "left")
        again = add(out.join(levels, [*keys, "rank"], "left")).withColumn("_level", F.coalesce(F.col("_level") + F.when(F.col("_found").isNull(), 1).otherwise(0), F.lit(0))).drop("_found")
        # One that has looked over the whole span and found nothing never will, as b only goes to stronger ones.
        again = held(again.filter(F.col("_width") * F.pow(F.lit(2.0), F.col("_level")) <= 4 * len(axes) * F.col("_span")))
        for x in (active, holders):
            x.unpersist()
        active, holders = again, new
    done = holders.filter("holder is not null").select(*keys, F.col("holder").alias("rank"), "b_component", "distance").join(ranks.select(*keys, "rank", "a_component"), [*keys, "rank"])
    done = cut(done.select(*keys, "a_component", "b_component", "distance"))
    for x in (active, there, holders):
        x.unpersist()
    return done


def projection(field: DataFrame, keys: list[str], along: str, value: str) -> DataFrame:
    """Maximum along an axis and trapezoid integral over it, for each cell of the others; null where nothing is valid."""
    w = Window.partitionBy(*keys).orderBy(along)
    ok = F.when(finite(F.col(value)), F.col(value))
    p = field.withColumns({"_v": ok, "_a": F.col(along).cast("double")}).filter("_v is not null").withColumn("_t", (F.col("_v") + F.lag("_v").over(w)) / 2 * (F.col("_a") - F.lag("_a").over(w)))
    return p.groupBy(*keys).agg(F.max("_v").alias("most"), F.coalesce(F.sum("_t"), F.lit(0.0)).alias("integral"))


def exceedance(field: DataFrame, value: str, percentile: float = 0.9, level: float | None = None) -> DataFrame:
    """The points at or above a level shared by all rows: given, or a percentile of the positive finite values. A level
    outside (0, maximum) leaves none."""
    ok = F.when(finite(F.col(value)) & (F.col(value) > 0), F.col(value))
    shared = field.agg(F.max(ok).alias("_top"))
    shared = shared.withColumn("level", F.lit(float(level))) if level is not None else with_quantiles(shared, field, [], ok, [percentile]).select("_top", F.get("q", F.lit(0)).alias("level"))
    return field.crossJoin(F.broadcast(shared)).filter((F.col("level") > 0) & (F.col("level") < F.col("_top")) & (F.col(value) >= F.col("level"))).drop("_top")
