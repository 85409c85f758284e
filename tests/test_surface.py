"""Isosurface meshes: the case table, closed surfaces, numbers of vertices, invalid corners."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from flumen.operators import surface


@pytest.fixture
def field(spark):
    def make(v, key="a"):
        rows = [(key, *map(int, at), float(v[at])) for at in np.ndindex(v.shape)]
        return spark.createDataFrame(rows, "volume string, iz int, iy int, ix int, q double")

    return make


def grid(n, f):
    z, y, x = np.meshgrid(*[np.arange(n) - (n - 1) / 2] * 3, indexing="ij")
    return f(z, y, x)


@pytest.mark.parametrize("case", range(256))
def test_every_case_has_closed_loops_over_its_cut_edges(case):
    cut = {i for i, (p, q, _) in enumerate(surface.EDGES) if (case >> p & 1) != (case >> q & 1)}
    found = [e for loop in surface.loops(case) for e in loop]
    assert set(found) == cut and len(found) == len(cut) and all(len(x) >= 3 for x in surface.loops(case))
    sides = Counter(s for t in surface.triangles(case) for s in zip(t, t[1:] + t[:1]))
    # Directed sides cancel but on the loops themselves.
    rest = {s for s, n in sides.items() if sides[s[::-1]] != n}
    assert rest == {s for loop in surface.loops(case) for s in zip(loop, loop[1:] + loop[:1])}


@pytest.mark.parametrize(("size", "shift"), [(32, 0), (5, 0), (4, 3)])
def test_a_sphere_is_closed(field, size, shift):
    f = field(grid(21, lambda z, y, x: 8 - np.sqrt(z * z + y * y + x * x)))
    if shift:
        f = f.selectExpr("volume", f"iz + {shift} AS iz", f"iy + {shift} AS iy", f"ix + {shift} AS ix", "q")
    t = surface.topology(surface.mesh(surface.cells(f, ["volume"], "q", 0.3, size), ["volume"], 0.3), ["volume"]).first()
    assert (t.euler, t.open_edges, t.crowded_edges) == (2, 0, 0)
    assert math.isclose(t.enclosed, 4 / 3 * math.pi * 7.7**3, rel_tol=0.02) and math.isclose(t.area, 4 * math.pi * 7.7**2, rel_tol=0.02)


def test_a_torus_has_a_hole(field):
    f = field(grid(25, lambda z, y, x: 3 - np.sqrt((np.sqrt(x * x + y * y) - 7) ** 2 + z * z)))
    t = surface.topology(surface.mesh(surface.cells(f, [], "q", 0.1), [], 0.1), []).first()
    assert (t.euler, t.open_edges, t.crowded_edges) == (0, 0, 0)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_field_gives_a_closed_surface(field, seed):
    """Ambiguous faces of all kinds, values on the level itself, a border of low values."""
    r = np.random.default_rng(seed)
    v = r.integers(0, 5, (9, 9, 9)).astype(float) if seed == 3 else r.normal(size=(9, 9, 9))
    v[[0, -1]] = v[:, [0, -1]] = v[:, :, [0, -1]] = -9
    m = surface.mesh(surface.cells(field(v), ["volume"], "q", 0.0 if seed < 3 else 2.0, 4), ["volume"], 0.0 if seed < 3 else 2.0)
    sides = Counter()
    for t in m.collect():
        ids = t.a.vertex, t.b.vertex, t.c.vertex
        sides.update(zip(ids, ids[1:] + ids[:1]))
    assert len(sides) > 300 and all(sides[s[::-1]] == n for s, n in sides.items())


def test_cells_with_an_invalid_corner_are_left_out(field):
    v = grid(8, lambda z, y, x: x + 0.25)
    v[3, 3, 3], v[6, 6, 4] = np.nan, np.inf
    f = field(v).filter("not (iz = 0 and iy = 0 and ix = 4)")
    m = surface.mesh(surface.cells(f, ["volume"], "q", 0.0, 4), ["volume"], 0.0)
    got = {(t.iz, t.iy, t.ix) for t in m.select("iz", "iy", "ix").collect()}
    bad = {(3, 3, 3), (6, 6, 4), (0, 0, 4)}
    near = lambda c: any(all(0 <= b - a <= 1 for a, b in zip(c, x)) for x in bad)
    assert got == {(z, y, 3) for z in range(7) for y in range(7) if not near((z, y, 3))} and m.count() == 2 * len(got)
    assert all(abs(t.a.x - 3.25) < 1e-12 for t in m.collect())


def test_vertices_are_shared_and_placed(spark, field):
    m = surface.mesh(surface.cells(field(grid(6, lambda z, y, x: z)), ["volume"], "q", 0.1), ["volume"], 0.1)
    v = surface.vertices(m, ["volume"])
    assert v.count() == 36 and m.count() == 50
    axes = spark.createDataFrame([("a", a, i, float(i * i)) for a in "xyz" for i in range(6)], "volume string, axis string, idx int, coord double")
    got = {(r.x, r.y, round(r.z, 9)) for r in surface.placed(v, ["volume"], axes).collect()}
    assert got == {(float(x * x), float(y * y), round(4 + 0.6 * 5, 9)) for x in range(6) for y in range(6)}


def test_no_surface_where_the_level_is_outside(field):
    f = field(grid(4, lambda z, y, x: x))
    assert surface.cells(f, ["volume"], "q", 99.0).count() == 0 and surface.cells(f.limit(0), ["volume"], "q", 0.0).count() == 0


def test_volumes_keep_their_own_surfaces(field):
    random.seed(1)
    a, b = field(grid(5, lambda z, y, x: x), "a"), field(grid(6, lambda z, y, x: -y), "b")
    t = {r.volume: r for r in surface.topology(surface.mesh(surface.cells(a.union(b), ["volume"], "q", 0.25), ["volume"], 0.25), ["volume"]).collect()}
    assert (t["a"].triangles, t["b"].triangles) == (32, 50) and t["a"].euler == t["b"].euler == 1
