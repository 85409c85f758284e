"""Isosurfaces as meshes: triangles over vertices that neighbouring cells share.

A cell is a cube of eight voxels. Where its corners lie on both sides of a level it has a case, and a case its triangles.
The cases' triangles follow from a rule: on each face of the cube, every run of inside corners is cut off by a segment;
the segments join to loops over the cube's edges, and a loop is cut into triangles. What happens on a face depends on its
four corners alone, so cells that share it agree and surfaces are closed. Cells with a corner that is missing or not
finite have no triangles.

Vertices lie on edges between neighbouring voxels, numbered by the edge; one that falls on a voxel itself has the voxel's
number, so that triangles of no extent have equal numbers and go.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ..plans.tiles import SIZE, by_tile

#: Axes in the order of a corner's bits: corner 1 is ahead in x, 2 in y, 4 in z.
AXES = ("ix", "iy", "iz")
CORNERS = [(k & 1, k >> 1 & 1, k >> 2) for k in range(8)]
#: The twelve edges: lower corner, upper corner, axis.
EDGES = [(k, k | 1 << a, a) for a in range(3) for k in range(8) if not k >> a & 1]
#: Indices of voxels are below 2^BITS, so that a vertex has a number of 64 bits.
BITS = 20


def _faces() -> Iterator[list[int]]:
    """The corners of each face, anticlockwise as seen from outside."""
    for a in range(3):
        b, c = (a + 1) % 3, (a + 2) % 3
        for side in (0, 1):
            ring = [side << a | p << b | q << c for p, q in ((0, 0), (1, 0), (1, 1), (0, 1))]
            yield ring if side else ring[::-1]


def loops(case: int) -> list[list[int]]:
    """Closed loops over edges (by number) round the inside corners, bits of case, of a cube; anticlockwise as seen from
    outside corners."""
    number = {frozenset(e[:2]): i for i, e in enumerate(EDGES)}
    inside = [bool(case >> k & 1) for k in range(8)]
    ahead: dict[int, int] = {}
    for ring in _faces():
        for i in range(4):
            if inside[ring[i]] and not inside[ring[i - 3]]:  # the run of inside corners ends with i
                j = i
                while inside[ring[j - 1]]:
                    j -= 1
                ahead[number[frozenset((ring[i], ring[i - 3]))]] = number[frozenset((ring[j], ring[j - 1]))]
    found = []
    while ahead:
        loop = [next(iter(ahead))]
        while (n := ahead.pop(loop[-1])) != loop[0]:
            loop.append(n)
        found.append(loop[::-1])
    return found


def _cuts(loop: list[int]) -> Iterator[list[tuple[int, int, int]]]:
    """Every way to cut a loop into triangles."""
    if len(loop) < 3:
        yield []
        return
    for k in range(1, len(loop) - 1):
        for left, right in itertools.product(_cuts(loop[: k + 1]), _cuts(loop[k:])):
            yield [*left, (loop[0], loop[k], loop[-1]), *right]


def triangles(case: int) -> list[tuple[int, int, int]]:
    """Edges of each triangle. Cuts within a face of the cube are avoided, as its neighbour could have the same one."""
    on_face = [{i for i, (p, q, _) in enumerate(EDGES) if p in ring and q in ring} for ring in map(set, _faces())]
    out = []
    for loop in loops(case):
        sides = {frozenset(x) for x in zip(loop, loop[1:] + loop[:1])}
        flat = lambda cut: sum(any({p, q} <= f for f in on_face) for t in cut for p, q in itertools.combinations(t, 2) if frozenset((p, q)) not in sides)  # noqa: E731, B023
        out += min(_cuts(loop), key=flat)
    return out


def cells(field: DataFrame, keys: list[str], value: str, level: float, size: int = SIZE) -> DataFrame:
    """The cells that the level cuts: keys, indices of the lowest corner, case and the corners' values."""

    def work(origin: np.ndarray, columns: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
        shape = np.minimum(at.max(0), size)
        grid = np.full(at.max(0) + 1, np.nan)
        grid[tuple(at.T)] = columns[value]
        corner = np.stack([grid[tuple(slice(d, d + n) for d, n in zip(c, shape))] for c in CORNERS], -1)
        case = ((corner >= level) << np.arange(8)).sum(-1)
        found = np.argwhere(np.isfinite(corner).all(-1) & (case > 0) & (case < 255))
        place = tuple(found.T)
        return {a: found[:, i] + origin[i] for i, a in enumerate(AXES)} | {"case": case[place].astype(np.int32), "corners": corner[place]}

    out = StructType([*(StructField(a, LongType()) for a in AXES), StructField("case", IntegerType()), StructField("corners", ArrayType(DoubleType()))])
    return by_tile(field.withColumn(value, F.col(value).cast("double")), keys, list(AXES), [value], work, out, size)


def _vertex(edge: tuple[int, int, int], level: float) -> Column:
    low, high, axis = edge
    a, b = F.get("corners", F.lit(low)), F.get("corners", F.lit(high))
    share = F.try_divide(F.lit(float(level)) - a, b - a)
    voxel = [F.col(x) + d for x, d in zip(AXES, CORNERS[low])]
    # On a voxel itself: that voxel's number with axis 3.
    at = [v + (F.when(share >= 1, 1).otherwise(0) if i == axis else 0) for i, v in enumerate(voxel)]
    own = F.when((share <= 0) | (share >= 1), 3).otherwise(axis)
    number = F.shiftleft(F.shiftleft(F.shiftleft(at[2].cast("long"), BITS) + at[1], BITS) + at[0], 2) + own
    return F.struct(number.alias("vertex"), *((v + (share if i == axis else 0.0)).alias(x[1:]) for i, (x, v) in enumerate(zip(AXES, voxel))))


def mesh(cut_cells: DataFrame, keys: list[str], level: float) -> DataFrame:
    """A row for each triangle of cells(): keys, the cell, and a, b, c, its vertices (vertex, x, y, z in steps of the
    grid), anticlockwise as seen from where values are below the level."""
    table = F.from_json(F.lit(json.dumps([triangles(k) for k in range(256)])), "array<array<array<int>>>")
    points = cut_cells.select(*keys, *AXES, F.get(table, F.col("case")).alias("_triangles"), F.array(*(_vertex(e, level) for e in EDGES)).alias("_points"))
    each = points.select(*keys, *AXES, F.explode("_triangles").alias("_t"), "_points")
    each = each.select(*keys, *AXES, *(F.get("_points", F.get("_t", F.lit(i))).alias(n) for i, n in enumerate("abc")))
    return each.filter("a.vertex <> b.vertex and b.vertex <> c.vertex and a.vertex <> c.vertex")


def vertices(triangles: DataFrame, keys: list[str]) -> DataFrame:
    """Each vertex of a mesh once: keys, vertex, x, y, z."""
    return triangles.select(*keys, F.explode(F.array("a", "b", "c")).alias("_v")).groupBy(*keys, "_v.vertex").agg(*(F.min(f"_v.{a}").alias(a) for a in "xyz"))


def placed(points: DataFrame, keys: list[str], axes: DataFrame) -> DataFrame:
    """Vertices (keys, vertex, x, y, z in steps) at coordinates: axes has keys, axis, idx, coord."""
    for a in "xyz":
        one = axes.filter(F.col("axis") == a)
        low = one.select(*keys, F.col("idx").cast("long").alias("_i"), F.col("coord").alias("_low"))
        high = one.select(*keys, F.col("idx").cast("long").alias("_j"), F.col("coord").alias("_high"))
        there = points.withColumn("_i", F.floor(a)).withColumn("_j", F.ceil(a)).join(low, [*keys, "_i"]).join(high, [*keys, "_j"])
        points = there.withColumn(a, F.col("_low") + (F.col(a) - F.col("_i")) * (F.col("_high") - F.col("_low"))).drop("_i", "_j", "_low", "_high")
    return points


def topology(triangles: DataFrame, keys: list[str]) -> DataFrame:
    """By keys: vertices, edges, triangles, edges with one triangle (open) and with more than two, Euler's number, area
    and the volume that is enclosed (in steps of the grid)."""
    point = lambda v: [F.col(f"{v}.{a}") for a in "xyz"]
    minus = lambda p, q: [x - y for x, y in zip(p, q)]
    cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    dot = lambda p, q: sum((x * y for x, y in zip(p, q)), F.lit(0.0))
    a, b, c = map(point, "abc")
    normal = cross(minus(b, a), minus(c, a))
    faces = triangles.groupBy(*keys).agg(F.count("*").alias("triangles"), (F.sum(F.sqrt(dot(normal, normal))) / 2).alias("area"), (F.sum(dot(a, cross(b, c))) / 6).alias("enclosed"))
    sides = F.explode(F.array(*(F.struct(F.least(f"{p}.vertex", f"{q}.vertex").alias("p"), F.greatest(f"{p}.vertex", f"{q}.vertex").alias("q")) for p, q in ("ab", "bc", "ca"))))
    each = triangles.select(*keys, sides.alias("_s")).groupBy(*keys, "_s").agg(F.count("*").alias("_n"))
    edges = each.groupBy(*keys).agg(F.count("*").alias("edges"), F.count_if(F.col("_n") == 1).alias("open_edges"), F.count_if(F.col("_n") > 2).alias("crowded_edges"))
    nodes = vertices(triangles, keys).groupBy(*keys).agg(F.count("*").alias("vertices"))
    joined = faces.join(edges, keys).join(nodes, keys) if keys else faces.crossJoin(F.broadcast(edges)).crossJoin(F.broadcast(nodes))  # a row each
    return joined.select(*keys, "vertices", "edges", "triangles", "open_edges", "crowded_edges", (F.col("vertices") - F.col("edges") + F.col("triangles")).alias("euler"), "area", "enclosed")
