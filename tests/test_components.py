"""Components by tiles, what touches the boundary, cells across a core, and matching by cells against plain loops."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from flumen.operators import vortex


def flood(active):
    """Components of a set of places in scan order."""
    left, out = set(active), []
    for start in sorted(active):
        if start in left:
            left.discard(start)
            queue, found = [start], []
            while queue:
                c = queue.pop()
                found.append(c)
                for i in range(len(c)):
                    for d in (-1, 1):
                        n = (*c[:i], c[i] + d, *c[i + 1 :])
                        if n in left:
                            left.discard(n)
                            queue.append(n)
            out.append(sorted(found))
    return out


@pytest.fixture
def cells(spark):
    def make(places, key="a"):
        return spark.createDataFrame([(key, *p, float(1 + sum(p) % 5)) for p in places], "k string, ix int, iy int, iz int, s double")

    return make


@pytest.mark.parametrize(("share", "size"), [(0.3, 4), (0.45, 4), (0.6, 5), (0.35, 32)])
def test_labels_agree_with_flooding(cells, share, size):
    r = np.random.default_rng(int(100 * share) + size)
    active = [tuple(int(i) - 3 for i in p) for p in np.argwhere(r.random((11, 9, 13)) < share)]
    got = vortex.label(cells(active), ["k"], size=size).collect()
    by = {}
    for x in got:
        by.setdefault(x.root, []).append((x.ix, x.iy, x.iz))
    want = flood(active)
    assert sorted(map(sorted, by.values())) == sorted(want) and len(got) == len(active)
    assert all(min((x.cell for x in got if x.root == root)) == root for root in list(by)[:20])
    assert [x["size"] for x in vortex.component_stats(vortex.label(cells(active), ["k"], size=size), ["k"], "s").orderBy("component").collect()] == [len(c) for c in want]


def test_a_component_that_winds_through_all_tiles(cells):
    snake, y = [], 0
    for x in range(0, 24, 2):
        snake += [(x, i, 0) for i in (range(20) if y == 0 else range(19, -1, -1))] + [(x + 1, 19 if y == 0 else 0, 0)]
        y = 1 - y
    assert vortex.label(cells(snake), [], size=4).select("root").distinct().count() == 1


def test_planes_and_keys(spark, cells):
    both = cells([(0, 0, 0), (0, 1, 0), (2, 2, 0)], "a").unionByName(cells([(0, 0, 0), (5, 5, 1)], "b"))
    got = vortex.component_stats(vortex.label(both, ["k", "iz"], ("ix", "iy"), size=2), ["k", "iz"], "s", ("ix", "iy")).collect()
    assert sorted((x.k, x.iz, x.component, x["size"]) for x in got) == [("a", 0, 1, 2), ("a", 0, 2, 1), ("b", 0, 1, 1), ("b", 1, 1, 1)]


def test_what_touches_the_boundary_can_be_removed(spark, cells):
    active = [(0, 3, 3), (1, 3, 3), (3, 3, 3), (3, 4, 3), (3, 5, 3), (5, 2, 7), (6, 6, 4)]
    grid = vortex.ends(cells([(0, 0, 0), (7, 7, 7)]), ["k"])
    labelled = vortex.label(cells(active), ["k"])
    got = vortex.component_stats(labelled, ["k"], "s", grid=grid, cell_volume=8.0, spacing=2.0).orderBy("component").collect()
    assert [(x["size"], x.touches_boundary) for x in got] == [(2, True), (3, False), (1, True), (1, False)]
    assert math.isclose(got[1].cells_across, (6 * 24 / math.pi) ** (1 / 3) / 2)
    inner = vortex.component_stats(labelled, ["k"], "s", grid=grid, remove_boundary=True).orderBy("component").collect()
    assert [(x.component, x["size"]) for x in inner] == [(1, 3), (2, 1)]  # numbers after what goes
    with pytest.raises(ValueError, match="ends"):
        vortex.component_stats(labelled, ["k"], "s", remove_boundary=True)


def one_by_one(a, b):
    free, out = dict(b), []
    for name, (_, p) in sorted(a.items(), key=lambda x: (-x[1][0], x[0])):
        if free:
            d, best = min((math.dist(p, q), n) for n, (_, q) in free.items())
            out.append((name, best, round(d, 9)))
            free.pop(best)
    return sorted(out)


@pytest.mark.parametrize(("n", "m", "kind", "most"), [(60, 60, "even", 99), (90, 40, "clustered", 99), (30, 40, "same place", 99), (9, 12, "even", 0), (7, 4, "clustered", 0)])
def test_matching_agrees_with_one_by_one(spark, n, m, kind, most):
    r = random.Random(n + m)
    point = {"even": lambda: tuple(r.random() for _ in range(3)), "clustered": lambda: tuple(r.choice([0.0, 100.0]) + r.gauss(0, 0.1) for _ in range(3)), "same place": lambda: (r.choice([0.0, 1.0]), 0.0, 0.0)}[kind]
    a, b = ({i: (float(r.randint(1, 20)), point()) for i in range(k)} for k in (n, m))
    table = lambda c: spark.createDataFrame([("p", i, s, *p) for i, (s, p) in c.items()], "k string, component long, integral double, x_weighted double, y_weighted double, z_weighted double")
    got = vortex.match_greedily(table(a), table(b), ["k"], ("x", "y", "z"), most).collect()
    assert sorted((x.a_component, x.b_component, round(x.distance, 9)) for x in got) == one_by_one(a, b)


def test_matching_keeps_keys_apart_and_needs_both_sides(spark):
    row = "k string, component long, integral double, x_weighted double, y_weighted double, z_weighted double"
    a = spark.createDataFrame([("p", 1, 1.0, 0.0, 0.0, 0.0), ("q", 1, 1.0, 5.0, 0.0, 0.0), ("only a", 1, 1.0, 0.0, 0.0, 0.0)], row)
    b = spark.createDataFrame([("p", 1, 1.0, 9.0, 0.0, 0.0), ("q", 1, 1.0, 6.0, 0.0, 0.0), ("only b", 1, 1.0, 0.0, 0.0, 0.0)], row)
    assert sorted((x.k, x.distance) for x in vortex.match_greedily(a, b, ["k"], ("x", "y", "z")).collect()) == [("p", 9.0), ("q", 1.0)]


@pytest.mark.parametrize("most", [99, 0])
def test_last_digits_of_centres_decide_nothing(spark, most):
    """Component 1 of b is as near as component 2, but for the last digit of a centre."""
    row = "k string, component long, integral double, x_weighted double, y_weighted double, z_weighted double"
    a = spark.createDataFrame([("p", 9, 3.0, 4.0, 2.0, 1.0), ("p", 5, 1.0, 3.0, 2.0, 2.0), ("q", 1, 1.0, 3.0, 0.0, 0.0)], row)
    b = spark.createDataFrame([("p", 1, 1.0, math.nextafter(3.0, 0.0), 1.0, 1.0), ("p", 2, 1.0, 3.0, 2.0, 2.0), ("q", 1, 1.0, math.nextafter(3.0, 9.0), 0.0, 0.0), ("q", 2, 1.0, 3.0, 0.0, 0.0)], row)
    got = vortex.match_greedily(a, b, ["k"], ("x", "y", "z"), most).collect()
    assert sorted((x.k, x.a_component, x.b_component, round(x.distance, 9)) for x in got) == [("p", 5, 2, 0.0), ("p", 9, 1, round(math.sqrt(2), 9)), ("q", 1, 1, 0.0)]


def test_a_grid_by_itself_has_a_score_and_a_verdict(spark):
    whole = [("a", x, y, z, 1.0) for x in range(3) for y in range(3) for z in range(3)]
    flat = [("b", x, 0, z, math.nan if x < 1 else 1.0) for x in range(4) for z in range(3)] + [("b", 3, 0, 2, 1.0)]
    holes = [("c", *p, 1.0) for _, *p, _ in whole[1:]]
    grid = vortex.inspect_grid(spark.createDataFrame(whole + flat + holes, "volume string, x int, y int, z int, u double"), ["volume"], "u")
    assert sorted((r.volume, r.score, r.verdict) for r in vortex.suitability(grid).collect()) == [("a", 0, "suitable"), ("b", 7, "too coarse"), ("c", 2, "qualitative")]


def test_grid_inspection_gives_the_score_and_the_verdict():
    from flumen import catalog_of_queries as core

    assert "score" in core.oracle_sql()["grid_inspection"] and "verdict" in core.oracle_sql()["grid_inspection"]
