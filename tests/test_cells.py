"""Cell planning and polygons against brute force, masks."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelquilt.operators.spatial import (cells_in_area, clip, clip_to_runs, covers_pixels, footprint_pairs, polygon_area, polygon_spans,
                                          region_share, span_pixels, study_grid)
from pixelquilt.plans import cells as C
from pixelquilt.plans import downloads as D
from pixelquilt.scale import numbered

EDGE = "id int, part string, ring int, seq int, hole boolean, x1 double, y1 double, x2 double, y2 double"
AREA = (312345.0, 4099871.0, 318002.5, 4103333.0)       # min x, min y, max x, max y
X0, Y1, M = 312340.0, 4103340.0, 2560.0


def brute_plan(train_cells, ring_max_km, water=(), water_max=0.95):
    """Rows (cell, role, dist_m, use) of the plan of AREA, and its ring distance, by the rules on every cell of a
    window that is larger than the ring."""
    wet, found = dict(water), []
    n = int(ring_max_km * 1000 // M) + 4
    for col in range(-n, 4 + n):
        for row in range(-n, 4 + n):
            x0, y1 = X0 + col * M, Y1 - row * M
            gaps = [max(lo - b, a - hi, 0.0) for lo, hi, a, b in ((AREA[0], AREA[2], x0, x0 + M), (AREA[1], AREA[3], y1 - M, y1))]
            spans = [max(min(hi, b) - max(lo, a), 0.0) for lo, hi, a, b in ((AREA[0], AREA[2], x0, x0 + M), (AREA[1], AREA[3], y1 - M, y1))]
            cell = f"x{x0:.0f}y{y1:.0f}"
            found.append((spans[0] * spans[1] >= 1, round(math.hypot(*gaps)), -y1, x0, cell, wet.get(cell, 0.0) < water_max))
    inside = sorted(f for f in found if f[0])
    if len(inside) >= train_cells:
        return [(f[4], "aoi", 0, True) for f in sorted(inside, key=lambda f: f[2:4])], None
    cap = ring_max_km * 1000
    others, reach = [f for f in found if not f[0] and f[1] <= cap], 0.0
    while reach < cap and len(inside) + sum(f[5] for f in others if f[1] <= reach) < train_cells:
        reach = min(reach + 1000, cap)
    ring = sorted((f for f in others if f[1] <= reach), key=lambda f: f[1:4])
    return [(f[4], "aoi", 0, True) for f in sorted(inside, key=lambda f: f[2:4])] + [(f[4], "ring", f[1], f[5]) for f in ring], reach


def edges(spark, rings, part="0"):
    """rings: list of (points, hole) of one part, or of (points, hole, part)."""
    rows = []
    for k, (pts, hole, *p) in enumerate(rings):
        for s in range(len(pts)):
            (a, b), (c, d) = pts[s], pts[(s + 1) % len(pts)]
            rows.append((0, p[0] if p else part, k, s, hole, float(a), float(b), float(c), float(d)))
    return spark.createDataFrame(rows, EDGE)


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


@pytest.fixture(scope="module")
def area(spark):
    return edges(spark, [(box(*AREA), False)])


def plan(spark, area, water=(), reach=60_000, **kw):
    wet = spark.createDataFrame([(c, w) for c, w in water] or [("none", 0.0)], "cell string, water double")
    cells = cells_in_area(area, X0, Y1, min(reach, kw.get("ring_max_km", 50.0) * 1000)).join(wet, "cell", "left")
    out = C.plan_cells(cells.withColumn("water", F.coalesce("water", F.lit(0.0))), **kw)
    return sorted(numbered(out, C.plan_order()).collect(), key=lambda r: r["ord"])


def test_grid(area):
    g = study_grid(area).first()
    assert (g["x0"], g["y1"]) == (X0, Y1)


@pytest.mark.parametrize("train_cells, ring_max_km", [(1, 5.0), (6, 5.0), (7, 5.0), (20, 5.0), (21, 9.0), (400, 0.5), (400, 4.3)])
def test_plan_against_brute_force(spark, area, train_cells, ring_max_km):
    want, reach = brute_plan(train_cells, ring_max_km)
    rows = plan(spark, area, train_cells=train_cells, ring_max_km=ring_max_km)
    assert [(r["cell"], r["role"], r["dist_m"], r["use"]) for r in rows] == want
    assert all((r["x0"], r["y1"]) == (X0 + r["col"] * M, Y1 - r["row"] * M) for r in rows)
    cells = cells_in_area(area, X0, Y1, ring_max_km * 1000).withColumn("water", F.lit(0.0))
    assert C.ring_distance(cells, train_cells, ring_max_km, 0.95).first()["D"] == reach


def test_water_grows_the_ring(spark, area):
    n = len(brute_plan(20, 9.0)[0])
    plain, _ = brute_plan(n, 9.0)                       # all of them are needed
    wet = [(cell, 0.99) for cell, role, _, _ in plain if role == "ring"][-3:]
    want, _ = brute_plan(n, 9.0, wet)
    rows = plan(spark, area, wet, train_cells=n, ring_max_km=9.0)
    assert [(r["cell"], r["role"], r["dist_m"], r["use"]) for r in rows] == want
    assert {r["cell"] for r in rows if not r["use"]} == {c for c, _ in wet}
    assert len(want) > len(plain)
    rows = plan(spark, area, wet, train_cells=n, ring_max_km=9.0, water_max=0.999)
    assert [r["cell"] for r in rows] == [f[0] for f in plain] and all(r["use"] for r in rows)


def test_area_only_plan(spark, area):
    cells = cells_in_area(area, X0, Y1, 0)
    rows = C.area_only_plan(cells).collect()
    assert sorted(r["cell"] for r in rows) == sorted(f[0] for f in brute_plan(1, 0.0)[0]) and all(r["use"] and r["water"] is None for r in rows)


def test_plan_notes():
    assert [k for k, _ in C.plan_notes(0, 0, 400)] == ["error"]
    assert [k for k, _ in C.plan_notes(1, 0, 400)] == ["error"]
    assert [k for k, _ in C.plan_notes(1, 50, 400)] == ["warning"]
    assert [k for k, _ in C.plan_notes(500, 5000, 400)] == ["warning"]
    assert C.plan_notes(4, 5000, 400) == []
    assert abs(C.training_cost(4)["stack_gb"] - 4 * 10.22e6 / 1e9) < 1e-3


def clip_area(pts, bx0, by0, bx1, by1):
    """Area of polygon and box by clipping at the four half-planes."""
    def clip(poly, inside, cut):
        out = []
        for i, b in enumerate(poly):
            a = poly[i - 1]
            if inside(a) != inside(b):
                out.append(cut(a, b))
            if inside(b):
                out.append(b)
        return out

    def at_x(x):
        return lambda a, b: (x, a[1] + (b[1] - a[1]) * (x - a[0]) / (b[0] - a[0]))

    def at_y(y):
        return lambda a, b: (a[0] + (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]), y)
    for inside, cut in ((lambda p: p[0] >= bx0, at_x(bx0)), (lambda p: p[0] <= bx1, at_x(bx1)),
                        (lambda p: p[1] >= by0, at_y(by0)), (lambda p: p[1] <= by1, at_y(by1))):
        pts = clip(pts, inside, cut)
        if not pts:
            return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1]))) / 2


def star(rng, n, cx, cy, r):
    a = np.sort(rng.random(n)) * 2 * math.pi
    d = r * (0.3 + 0.7 * rng.random(n))
    return [(cx + x * math.cos(t), cy + x * math.sin(t)) for x, t in zip(d, a)]


@pytest.mark.parametrize("seed", [1, 2])
def test_overlap_with_hole_against_clipping(spark, seed):
    rng = np.random.default_rng(seed)
    outer = star(rng, 40, 5000.0, -5000.0, 6000.0)
    hole = [(5000 + (x - 5000) * 0.2, -5000 + (y + 5000) * 0.2) for x, y in outer]
    if seed == 2:
        hole = hole[::-1]
    got = {(r["col"], r["row"]): r for r in cells_in_area(edges(spark, [(outer, False), (hole, True)]), 0.0, 0.0, 3000,
                                                          m=1000.0).collect()}
    for c in range(-3, 13):
        for r in range(-3, 13):
            b = (c * 1000.0, -(r + 1) * 1000.0, (c + 1) * 1000.0, -r * 1000.0)
            want = clip_area(outer, *b) - clip_area(hole, *b)
            have = got.get((c, r))
            assert (have["area"] if have else 0.0) == pytest.approx(want, abs=1e-3)
            if want > 1:
                assert have["dist"] == 0
    total = polygon_area(edges(spark, [(outer, False), (hole, True)])).first()["area"]
    assert sum(r["area"] for r in got.values()) == pytest.approx(total, rel=1e-9)


def test_pixel_masks(spark):
    rng = np.random.default_rng(7)
    outer, second = star(rng, 60, 500.0, -500.0, 450.0), box(20.0, -90.0, 95.0, -15.0)
    e = edges(spark, [(outer, False, "a"), (box(480.0, -520.0, 520.0, -480.0), True, "a"), (second, False, "b")])
    got = {(r["r"], r["c"]) for r in span_pixels(polygon_spans(e, 0.0, 0.0), 100, 100).collect()}

    def inside(ring, x, y):
        n = 0
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
            if min(b, d) <= y < max(b, d) and a + (y - b) * (c - a) / (d - b) <= x:
                n += 1
        return n % 2
    for r in range(100):
        for c in range(100):
            x, y = (c + 0.5) * 10, -(r + 0.5) * 10
            a = (inside(outer, x, y) + inside(box(480.0, -520.0, 520.0, -480.0), x, y)) % 2
            assert ((r, c) in got) == bool(a or inside(second, x, y))
    assert covers_pixels(e, 0.0, 0.0, 10) and not covers_pixels(edges(spark, [(box(1.0, -4.0, 3.0, -2.0), False)]), 0.0, 0.0, 1)


def test_clip_by_runs(spark):
    """The run clip keeps what the pixel mask keeps, for overlapping parts and pixels beyond them, and makes no pixel."""
    rng = np.random.default_rng(3)
    e = edges(spark, [(star(rng, 30, 400.0, -300.0, 300.0), False, "a"), (star(rng, 9, 600.0, -400.0, 250.0), False, "b"), (box(20.0, -90.0, 95.0, -15.0), False, "c")])
    layer = spark.range(120 * 90).select(F.floor(F.col("id") / 120).alias("r"), (F.col("id") % 120).alias("c"), F.col("id").alias("v"))
    want = {(r["r"], r["c"]) for r in span_pixels(polygon_spans(e, 0.0, 0.0), 90, 120, []).collect()}
    rows = clip(layer, e, 0.0, 0.0).collect()
    assert {(r["r"], r["c"]) for r in rows} == want and len(rows) == len(want) > 500
    assert all(r["v"] == r["r"] * 120 + r["c"] for r in rows)
    runs = spark.createDataFrame([(0, 3, 5), (0, 9, 9), (2, 0, 119)], "r long, c0 long, c1 long")
    cut = clip_to_runs(layer, runs)
    assert sorted((r["r"], r["c"]) for r in cut.collect()) == [(0, 3), (0, 4), (0, 5), (0, 9)] + [(2, c) for c in range(120)]
    assert "Generate" not in cut._jdf.queryExecution().executedPlan().toString() and clip_to_runs(layer, runs.limit(0)).count() == 0


def test_region_share(spark):
    px = spark.range(1000).select((F.col("id") % 10).alias("c"), F.floor(F.col("id") / 10).alias("r"))
    for cut, note in ((10, "inside"), (4, "partial"), (0, "outside")):
        row = region_share(px, px.where(F.col("c") < cut)).first()
        assert row["note"] == note and row["inside"] == pytest.approx(cut / 10)


def test_footprints_in_one_bucket_are_found_once(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0, 3.0, 3.0), (2, 3.02, 0.0, 4.0, 1.0)],
                              "id int, minx double, miny double, maxx double, maxy double")
    c = spark.createDataFrame([("a", 2.97, 0.4, 3.0, 0.6), ("b", 2.9, 2.9, 3.5, 3.5)],
                              "cell string, minx double, miny double, maxx double, maxy double")
    got = sorted((r["id"], r["cell"]) for r in footprint_pairs(s, c).collect())
    assert got == [(1, "a"), (1, "b"), (2, "a")]


def test_download_counts(spark):
    cells = spark.createDataFrame([("a", "aoi"), ("b", "ring")], "cell string, role string")
    none = spark.createDataFrame([], "cell string, layer string")
    bench = ["GMTCH", "GFCH", "HRCH"]

    def count(have, method):
        r = D.requests(D.jobs(D.missing_layers(cells, have, "AE", bench), method), method).first()
        return r["jobs"], r["requests"]
    assert count(none, "gee") == (11, 33)
    one = spark.createDataFrame([("a", "S1")], "cell string, layer string")
    assert count(one, "gee") == (10, 29) and count(one, "local") == (10, 30)
    done = spark.createDataFrame([("a", "GMTCH")], "cell string, layer string")
    assert D.missing_layers(cells, done, "AE", bench).where("layer = 'Tolan_1m'").count() == 0
    seasonal = D.jobs(D.missing_layers(cells, none, "T", []), "local").where("bundle = 'S1_asc'").collect()
    assert [len(r["layers"]) for r in seasonal] == [4, 4]
    with pytest.raises(RuntimeError, match="other settings"):
        D.require_settings(one.withColumn("reason", F.lit("year 2019")))
