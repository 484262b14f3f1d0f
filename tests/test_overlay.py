"""Planar overlay against hand cases and a slab sweep."""
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelquilt.operators import overlay as O
from pixelquilt.operators.spatial import cells_in_area

EDGE = "k int, g string, x1 double, y1 double, x2 double, y2 double"


def box(x, y, w, h=None):
    return [(x, y), (x + w, y), (x + w, y + (h or w)), (x, y + (h or w))]


def ring_edges(points):
    return [(*a, *b) for a, b in zip(points, points[1:] + points[:1])]


def table(spark, planes):
    """planes: {k: [(g, points), ...]}"""
    return spark.createDataFrame([(k, g, *map(float, e)) for k, rings in planes.items() for g, p in rings for e in ring_edges(p)], EDGE)


def sweep(rings, holds):
    """Area where holds(set of polygons) by slabs between all ends and crossings."""
    es = [(g, *e) for g, p in rings for e in ring_edges(p) if e[1] != e[3]]
    ys = {y for _, _, a, _, b in es for y in (a, b)}
    for (_, ax, ay, bx, by), (_, cx, cy, dx, dy) in itertools.combinations(es, 2):
        det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
        if det:
            t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det
            if 0 <= t <= 1:
                ys.add(ay + t * (by - ay))
    total, ys = 0.0, sorted(ys)
    for lo, hi in zip(ys, ys[1:]):
        mid = (lo + hi) / 2
        cuts = sorted((a + (mid - b) * (c - a) / (d - b), g) for g, a, b, c, d in es if min(b, d) < mid < max(b, d))
        inside = set()
        for (x, g), (x2, _) in zip(cuts, cuts[1:] + [(None, None)]):
            inside ^= {g}
            if inside and holds(inside):
                total += (x2 - x) * (hi - lo)
    return total


CASES = {0: ([box(0, 0, 10), box(5, 5, 10)], 175), 1: ([box(0, 0, 10), box(10, 0, 10)], 200), 2: ([box(0, 0, 10), box(0, 0, 10)], 100),
         3: ([[(0, 0), (10, 10), (10, 0), (0, 10)]], 50), 4: ([box(0, 0, 10), box(2, 2, 3)], 100), 5: ([box(0, 0, 10), box(0, 5, 10)], 150),
         6: ([box(0, 0, 10), box(5, 0, 10)[::-1]], 150), 7: ([box(0, 0, 100), box(3, 3, 1), box(99, 99, 5)], 10024),
         8: ([box(0, 0, 10), [(10, 2), (20, 5), (10, 8)]], 130), 9: ([[(0, 0), (0, 0), (4, 0), (4, 4)]], 8)}


@pytest.mark.parametrize("m", [None, 1.0, 7.3, 1000.0])
def test_unions(spark, m):
    planes = {k: [(str(i), p) for i, p in enumerate(rings)] for k, (rings, _) in CASES.items()}
    got = {r["k"]: r["area"] for r in O.union_area(table(spark, planes), m).collect()}
    assert got == {k: pytest.approx(area, abs=1e-9) for k, (_, area) in CASES.items()}


def test_union_boundary(spark):
    """Shared sides go, holes stay, the area lies to the left."""
    frame = [box(0, 0, 30, 10), box(0, 20, 30, 10), box(0, 5, 10, 20), box(20, 5, 10, 20)]
    rows = O.union_edges(table(spark, {0: [(str(i), p) for i, p in enumerate(frame)]})).collect()
    assert sum(math.dist((r["x1"], r["y1"]), (r["x2"], r["y2"])) for r in rows) == pytest.approx(120 + 40)
    assert sum(r["x1"] * r["y2"] - r["x2"] * r["y1"] for r in rows) / 2 == pytest.approx(800)
    starts, ends = sorted((r["x1"], r["y1"]) for r in rows), sorted((r["x2"], r["y2"]) for r in rows)
    assert starts == ends


def star(rng, n, cx, cy, r):
    turn = np.sort(rng.random(n)) * 2 * math.pi
    return [(cx + d * math.cos(t), cy + d * math.sin(t)) for d, t in zip(r * (0.2 + rng.random(n)), rng.permutation(turn) if n < 9 else turn)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_polygons(spark, seed):
    """Crossing and self-crossing rings: unions and overlaps with a region of several parts."""
    rng = np.random.default_rng(seed)
    areas = [(f"a{i}", star(rng, 7 if i % 2 else 14, *(rng.random(2) * 100), 30)) for i in range(6)]
    parts = [(f"p{i}", star(rng, 12 if i % 2 else 5, *(rng.random(2) * 100), 35)) for i in range(5)]
    both = table(spark, {0: areas + parts})
    assert O.union_area(both).first()["area"] == pytest.approx(sweep(areas + parts, any), rel=1e-9)
    got = O.region_shares(both.where("g LIKE 'a%'").withColumnRenamed("g", "id"), both.where("g LIKE 'p%'").withColumnRenamed("g", "part"), 11.0)
    rows = {r["id"]: r for r in got.collect()}
    for g, p in areas:
        area, inside = sweep([(g, p)], any), sweep([(g, p), *parts], lambda s: g in s and len(s) > 1)
        assert rows[g]["area"] == pytest.approx(area, rel=1e-9) and rows[g]["inside"] == pytest.approx(inside / area, abs=1e-9)
        assert rows[g]["note"] == ("outside" if inside == 0 else "inside" if inside >= 0.999 * area else "partial")


def test_shares_outside_and_whole(spark):
    areas = table(spark, {0: [("far", box(500, 500, 10)), ("in", box(2, 2, 3)), ("same", box(0, 0, 10)), ("half", box(5, 0, 10))]})
    region = table(spark, {0: [("r", box(0, 0, 10))]})
    got = {r["id"]: (r["note"], round(r["inside"], 9)) for r in O.region_shares(areas.withColumnRenamed("g", "id"), region.withColumnRenamed("g", "part")).collect()}
    assert got == {"far": ("outside", 0.0), "in": ("inside", 1.0), "same": ("inside", 1.0), "half": ("partial", 0.5)}


def test_cells_of_overlapping_parts(spark):
    """Overlap areas of cells are right once overlapping parts are dissolved."""
    rng = np.random.default_rng(5)
    rings = [(str(i), star(rng, 13, 3000 + 900 * i, -3000.0, 2500.0)) for i in range(3)]
    border = O.union_edges(table(spark, {0: rings})).select(F.lit(0).alias("id"), F.lit("0").alias("part"), F.lit(0).alias("ring"), F.lit(0).alias("seq"),
                                                          F.lit(False).alias("hole"), "x1", "y1", "x2", "y2")
    cells = cells_in_area(border, 0.0, 0.0, 0, m=1000.0)
    assert cells.agg(F.sum("area")).first()[0] == pytest.approx(sweep(rings, any), rel=1e-9)
    assert cells.agg(F.max("area")).first()[0] <= 1e6 + 1e-3
