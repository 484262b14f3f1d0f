"""Raw scenes on cell grids: constants through the whole chain, zones, masks, edges of scenes, resampling by hand."""
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelquilt.functions.geodesy import utm_forward, utm_inverse
from pixelquilt.operators import focal, scene_grid as G

ZONE, X0, Y1, N, HALO = 32650, 829000.0, 551000.0, 16, G.HALO
SCENE = "sid string, epsg int, affine array<double>, height int, width int"
T0 = dt.datetime(2020, 6, 1)


def scene(spark, sid, vv, epsg=ZONE, vh=0.02, slope=0.0, margin=5, shift=(3.3, 6.1)):
    """(metadata, pixels) of a scene that covers the cell's grid; its ground falls to the north by `slope`."""
    size = (N + 2 * HALO) * 10
    corners = spark.createDataFrame([(X0 - HALO * 10 + dx * size, Y1 + HALO * 10 - dy * size) for dx in (0, 1) for dy in (0, 1)], "x double, y double")
    if epsg != ZONE:
        lon, lat = utm_inverse(F.col("x"), F.col("y"), F.lit(ZONE))
        x, y = utm_forward(F.col("lon"), F.col("lat"), F.lit(epsg))
        corners = corners.select(lon.alias("lon"), lat.alias("lat")).select(x.alias("x"), y.alias("y"))
    p = [tuple(r) for r in corners.collect()]
    x0 = math.floor(min(x for x, _ in p) / 10) * 10 - margin * 10 - shift[0]
    y1 = math.ceil(max(y for _, y in p) / 10) * 10 + margin * 10 + shift[1]
    width, height = int((max(x for x, _ in p) - x0) / 10) + margin + 2, int((y1 - min(y for _, y in p)) / 10) + margin + 2
    meta = (sid, epsg, [10.0, 0.0, x0, 0.0, -10.0, y1], height, width)
    px = spark.range(height * width).select(F.lit(sid).alias("sid"), F.floor(F.col("id") / width).alias("r"), (F.col("id") % width).alias("c"))
    north = F.lit(y1) - (F.col("r") + 0.5) * 10 - Y1
    return meta, px.select("sid", "r", "c", F.lit(float(vv)).alias("vv"), F.lit(vh).alias("vh"), F.lit(1.0).alias("m"),
                           (100.0 - F.lit(slope) * north).alias("elev"), F.lit(1).alias("tv"))


def tables(spark, made, acquisitions, angle=38.0):
    """The tables of scene_decibels for one cell; acquisitions: (id, members) in daily order."""
    scenes = spark.createDataFrame([m for m, _ in made], SCENE)
    pixels = made[0][1]
    for _, px in made[1:]:
        pixels = pixels.unionByName(px)
    acq = spark.createDataFrame([(i, T0 + dt.timedelta(days=k), heading, members) for k, (i, members, heading) in enumerate(acquisitions)],
                                "id string, t timestamp_ntz, heading double, members array<string>")
    cells = spark.createDataFrame([("A", ZONE, X0, Y1)], "cell string, epsg int, x0 double, y1 double")
    size = F.sequence(F.lit(0), F.lit(N + 2 * HALO - 1))
    angles = (acq.select(F.col("id").alias("sid"), F.lit("A").alias("cell"), F.explode(size).alias("r")).withColumn("c", F.explode(size))
              .withColumn("angle", F.lit(angle) if not isinstance(angle, dict) else F.create_map(*[F.lit(x) for kv in angle.items() for x in kv])[F.col("sid")])
              .withColumn("foot", F.lit(1)))
    return pixels, scenes, acq, cells, scenes.select("sid", F.lit("A").alias("cell")), angles


def test_constant_scenes_of_two_zones(spark):
    made = [scene(spark, "a", 0.1), scene(spark, "b", 0.1), scene(spark, "z", 0.1, 32651)]
    args = tables(spark, made, [("a", ["a", "b", "z"], -10.0), ("z", ["a", "b", "z", "gone"], -10.0)])
    want = [10 * math.log10(v / math.cos(math.radians(38.0))) for v in (0.1, 0.02)]
    for r in G.scene_decibels(*args, N, HALO).groupBy("id").agg(*[f(b).alias(f"{f.__name__}_{b}") for b in ("vv", "vh") for f in (F.count, F.min, F.max)]).collect():
        for band, value in zip(("vv", "vh"), want):
            assert r[f"count_{band}"] == N * N and r[f"min_{band}"] == pytest.approx(value, abs=1e-5) and r[f"max_{band}"] == pytest.approx(value, abs=1e-5)


def test_median_masks_and_seasons(spark):
    made = [scene(spark, "a", 0.1), scene(spark, "b", 0.4), scene(spark, "edge", 0.1)]
    args = tables(spark, made, [(s, [s], -10.0) for s in ("a", "b", "edge")], {"a": 38.0, "b": 38.0, "edge": 29.0})
    db = {(r["id"], r["r"], r["c"]): r["vv"] for r in G.scene_decibels(*args, N, HALO).collect()}
    assert len(db) == 3 * N * N and all((v is None) == (i == "edge") for (i, _, _), v in db.items())
    rows = {(r["r"], r["c"]): r for r in G.scene_composite(*args, N, HALO).where("band = 'vv'").collect()}
    assert len(rows) == N * N
    assert all(r["n"] == 2 and r["median"] == pytest.approx((db["a", *k] + db["b", *k]) / 2) for k, r in rows.items())
    assert {r["season"] for r in G.scene_composite(*args, N, HALO, seasonal=True).select("season").distinct().collect()} == {2}


@pytest.mark.parametrize("slope, seen", [(0.2, True), (2.0, False)])
def test_slopes_towards_the_sensor(spark, slope, seen):
    args = tables(spark, [scene(spark, "t", 0.1, slope=slope)], [("t", ["t"], 0.0)])
    values = [r["vv"] for r in G.scene_decibels(*args, N, HALO).collect()]
    flat = 10 * math.log10(0.1 / math.cos(math.radians(38.0)))
    assert len(values) == N * N and all((v is not None and abs(v - flat) > 0.2) if seen else v is None for v in values)


@pytest.mark.parametrize("block", [128, 5])
def test_resampling_by_hand(spark, monkeypatch, block):
    """Bilinear and nearest with masked pixels, on and beyond the edges of a small scene; quads cross block borders."""
    monkeypatch.setattr(focal, "BLOCK", block)
    rng = np.random.default_rng(1)
    h, w, n = 11, 9, 14
    v, m = rng.random((h, w)), np.where(rng.random((h, w)) > 0.25, rng.choice([0.5, 1.0], (h, w)), 0.0)
    affine = [10.0, 0.0, 1013.3, 0.0, -10.0, 1987.1]
    px = spark.createDataFrame([("s", r, c, float(v[r, c]), float(m[r, c])) for r in range(h) for c in range(w)], "sid string, r int, c int, v double, m double")
    scenes = spark.createDataFrame([("s", ZONE, affine, h, w)], SCENE)
    cells = spark.createDataFrame([("A", ZONE, 1000.0, 2000.0)], "cell string, epsg int, x0 double, y1 double")
    at = G.on_targets(G.target_pixels(cells, scenes.select("sid", F.lit("A").alias("cell")), scenes, n, 0), G.quads(px, scenes, ["v", "m"]))
    bil = {(r["r"], r["c"]): (r["v"], r["w"]) for r in G.bilinear_values(at, ["v"]).collect()}
    near = {(r["r"], r["c"]): r["v"] for r in G.nearest_values(at, ["v"]).collect()}
    assert len(bil) == len(near) == n * n

    def pixel(a, r, c):
        return a[r, c] if 0 <= r < h and 0 <= c < w else 0.0
    for (r, c), (value, weight) in bil.items():
        u, q = (1000 + (c + 0.5) * 10 - affine[2]) / 10 - 0.5, (affine[5] - 2000 + (r + 0.5) * 10) / 10 - 0.5
        i, j, num, den, total = math.floor(q), math.floor(u), 0.0, 0.0, 0.0
        for y, x in ((i, j), (i, j + 1), (i + 1, j), (i + 1, j + 1)):
            share = (1 - abs(q - y)) * (1 - abs(u - x))
            total += share * pixel(m, y, x)
            if pixel(m, y, x) > 0:
                num, den = num + share * pixel(v, y, x), den + share
        assert value == pytest.approx(num / den if den else 0.0, abs=1e-9) and weight == pytest.approx(round(total * 255) / 255, abs=1e-12)
        y, x = round(q), round(u)
        assert near[r, c] == (v[y, x] if 0 <= y < h and 0 <= x < w else None)


def test_pixels_go_to_no_more_blocks_than_their_halo(spark):
    px = spark.range(300 * 300).select(F.lit("s").alias("sid"), F.floor(F.col("id") / 300).alias("r"), (F.col("id") % 300).alias("c"))
    dealt = focal._dealt(px, ["sid"], 1).groupBy("r", "c").count()
    inner = (F.col("r") % 128).between(1, 126) & (F.col("c") % 128).between(1, 126)
    assert dealt.where(inner & (F.col("count") > 1)).count() == 0 and dealt.agg(F.max("count")).first()[0] <= 4
