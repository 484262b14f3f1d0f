"""Operators against NumPy and closed forms."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pixelquilt.functions import encode as enc
from pixelquilt.functions.geodesy import utm_forward, utm_inverse
from pixelquilt.functions.nodata import encode_label, to_null
from pixelquilt.operators import metrics as M
from pixelquilt import scale
from pixelquilt.operators import radar as A
from pixelquilt.operators.blocks import block_percentile, height_reference
from pixelquilt.operators import focal
from pixelquilt.operators.focal import boxcar, boxcar_and_terrain, gradients, terrain, terrain_geometry
from pixelquilt.operators.layout import mosaic_layout, pad_tiles, tile_rasters
from pixelquilt.operators.resample import bilinear, nearest_join
from pixelquilt.operators.spatial import geodesic_area
from pixelquilt.operators.tiles import covering, predict_blocks, predict_tiles, tile_origins, tile_scorer
from pixelquilt.plans.report import reference_section
from pixelquilt.schema import ANNUAL_BANDS, SEASONAL_BANDS, canonical, n_channels, needs_seasonal


def raster(spark, a, name="v", **extra):
    h, w = a.shape
    rows = [(int(r), int(c), None if np.isnan(a[r, c]) else float(a[r, c])) for r in range(h) for c in range(w)]
    df = spark.createDataFrame(rows, f"r long, c long, {name} double")
    for k, v in extra.items():
        df = df.withColumn(k, v)
    return df


def array(df, shape, value="v"):
    out = np.full(shape, np.nan)
    for r in df.select("r", "c", value).collect():
        if r[2] is not None:
            out[r[0], r[1]] = r[2]
    return out


# ------------------------------------------------------------------ encodings
def test_encoding_literals(spark):
    emb = [float("nan"), -1.0, -0.99995, 0.5, 5.6] + [0.0] * 59
    row = spark.createDataFrame([(emb, -5.0, [-12.345, float("nan")], [float(x) for x in (-3, 70000, 1.9, 0, 1, 2, 3, 4, 5)])],
                                "e array<double>, d double, s array<double>, o array<double>")
    x = row.select(enc.encode_annual(F.col("e"), F.col("d"), F.col("s"), F.col("o")).alias("x")).first()["x"]
    assert len(x) == len(ANNUAL_BANDS) == 76
    assert x[:6] == [0, 0, 0, 15000, 65535, 10000] and x[64] == 0 and x[65:67] == [3765, 0] and x[67:70] == [0, 65535, 1]
    s = spark.createDataFrame([([-50.0, -49.995, 605.35, -60.0] + [None] * 4, [6.5535, -0.00001, 0.5] + [7.0] * 33)],
                              "s array<double>, o array<double>")
    y = s.select(enc.encode_seasonal(F.col("s"), F.col("o")).alias("x")).first()["x"]
    assert len(y) == len(SEASONAL_BANDS) == 44
    a = (np.array([-50.0, -49.995, 605.35, -60.0]) + 50.0) * 100.0
    assert y[:4] == np.clip(a, 0, 65535).astype(np.uint16).tolist() and y[4:8] == [0] * 4
    assert y[8:11] == np.clip(np.array([6.5535, -0.00001, 0.5]) * 1e4, 0, 65535).astype(np.uint16).tolist() and y[11] == 65535
    with pytest.raises(Exception, match="expected 8 radar"):
        s.select(enc.encode_seasonal(F.slice("s", 1, 7), F.col("o"))).collect()


def test_labels_and_sentinels(spark):
    df = spark.createDataFrame([(float("nan"),), (-9999.0,), (None,), (3.5,), (255.0,), (-999.0,), (0.0,)], "v double")
    assert [r[0] for r in df.select(encode_label(F.col("v"))).collect()] == [-999.0, -999.0, -999.0, 3.5, 255.0, -999.0, 0.0]
    got = [r[0] for r in df.select(to_null(F.col("v"), 255.0, -999.0)).collect()]
    assert got == [None, None, None, 3.5, None, None, 0.0]


def test_representations(spark):
    assert [n_channels(x) for x in ("AE", "A", "E", "T", "TE")] == [76, 12, 64, 45, 109]
    assert canonical("IE") == "AE" and canonical("I") == "A" and needs_seasonal("TE") and not needs_seasonal("AE")
    with pytest.raises(ValueError):
        canonical("X")
    one = spark.createDataFrame([("X", [1] * 76)], "n string, a array<int>")
    with pytest.raises(Exception, match="unknown representation"):
        one.select(enc.canonical_name(F.col("n"))).collect()
    with pytest.raises(Exception, match="seasonal bands missing"):
        one.select(enc.assemble("T", F.col("a"), F.lit(None).cast("array<int>"))).collect()
    wrapped = spark.createDataFrame([([9999, 10000, 0, 65535],)], "x array<int>")
    assert wrapped.select(enc.forest_features(F.col("x"), "paper", 3)).first()[0] == [65535, 0, 55536, 65535]


# ------------------------------------------------------------------ blocks, resampling, focal
def test_block_percentile(spark):
    rng = np.random.default_rng(0)
    a = rng.random((30, 40)) * 30
    a[:10, :10] = np.nan
    a[12, 13:18] = np.nan
    got = array(block_percentile(raster(spark, a), 10, {"q": 0.9}), (3, 4), "q")
    want = np.full((3, 4), np.nan)
    for i in range(3):
        for j in range(4):
            b = a[i * 10:(i + 1) * 10, j * 10:(j + 1) * 10]
            if np.isfinite(b).any():
                want[i, j] = np.float32(np.nanpercentile(b, 90))
    assert np.array_equal(np.isnan(got), np.isnan(want)) and np.allclose(got, want, equal_nan=True, rtol=1e-7)


def test_reference_heights_reject_mixtures(spark):
    meta = spark.createDataFrame([("a", 1, [1.0, 0.0, 0.0, 0.0, -1.0, 0.0], 1.0, 1.0, False, 0.0), ("b", 2, [10.0, 0.0, 0.0, 0.0, -10.0, 0.0], 10.0, 10.0, False, 0.0)],
                                 "source string, prio int, affine array<double>, rx double, ry double, geographic boolean, lat double")
    px = spark.createDataFrame([("a", 0, 0, 5000.0), ("b", 0, 0, 5000.0)], "source string, r long, c long, v double")
    with pytest.raises(ValueError, match="mixed resolution"):
        height_reference(meta, px, 0.0, 0.0)
    with pytest.raises(ValueError, match="metres"):
        height_reference(meta.where("source = 'b'"), px, 0.0, 0.0)
    assert height_reference(meta.where("source = 'b'"), px, 0.0, 0.0, scale=0.01).first()["v"] == 50.0


def test_resampling(spark):
    rng = np.random.default_rng(2)
    src, m = rng.random((20, 22)), (rng.random((20, 22)) > 0.2) * rng.choice([0.5, 1.0], (20, 22))
    t = [10.0, 0.0, 103.3, 0.0, -10.0, 297.1]
    x0, y1 = 110.0, 290.0
    target = raster(spark, np.zeros((12, 12))).select("r", "c")
    affine = F.array(*[F.lit(x) for x in t])
    s = raster(spark, src).join(raster(spark, m.astype(float), "m"), ["r", "c"])
    near = array(nearest_join(target, s, affine, x0, y1, 10.0), (12, 12))
    bil = bilinear(target, s, affine, x0, y1, 10.0)
    bv, bm = array(bil, (12, 12)), array(bil, (12, 12), "m")
    for r in range(12):
        for c in range(12):
            x, y = x0 + (c + 0.5) * 10, y1 - (r + 0.5) * 10
            u, v = (x - t[2]) / 10 - 0.5, (t[5] - y) / 10 - 0.5
            assert near[r, c] == src[int(np.rint(v)), int(np.rint(u))]
            i, j, fu, fv = int(v // 1), int(u // 1), u % 1, v % 1
            w = np.array([[(1 - fu) * (1 - fv), fu * (1 - fv)], [(1 - fu) * fv, fu * fv]])
            k = m[i:i + 2, j:j + 2]
            den = (w * (k > 0)).sum()
            want = (w * (k > 0) * src[i:i + 2, j:j + 2]).sum() / den if den else 0.0
            assert bv[r, c] == pytest.approx(want, abs=1e-12)
            assert bm[r, c] == pytest.approx(round((w * k).sum() * 255) / 255, abs=1e-12)


@pytest.mark.parametrize("block", [128, 16, 7])
def test_boxcar_against_sum(spark, monkeypatch, block):
    monkeypatch.setattr(focal, "BLOCK", block)
    a = np.random.default_rng(4).random((25, 31))
    a[3:8, 4:9] = np.nan
    got = array(boxcar(raster(spark, a), [], ["v"]), a.shape, "box_v")
    p = np.pad(np.nan_to_num(a), 7)
    want = sum(p[i:i + 25, j:j + 31] for i in range(15) for j in range(15)) / 225
    assert np.allclose(got, want, atol=1e-13)


def test_tile_rasters(spark):
    a = np.random.default_rng(6).random((30, 26))
    px = raster(spark, a).withColumn("label", F.when(F.col("r") < 25, F.col("v") * 30))
    pixels, index = tile_rasters(px, 30, 26, 500000.0, 4000000.0, tile=13)
    at = {r["chip"]: (r["row"], r["col"], r["x"], r["y"], r["n"]) for r in index.collect()}
    assert at == {i: (r, c, 500000.0 + c * 10, 4000000.0 - r * 10, min(13, 25 - r) * 13)
                  for i, (r, c) in enumerate((r, c) for r in (0, 13) for c in (0, 13))}
    got = pixels.toPandas()
    assert len(got) == 4 * 169
    for r in got.itertuples():
        row, col = at[r.chip][0] + r.pr, at[r.chip][1] + r.pc
        assert r.v == a[row, col] and (np.isnan(r.label) if row >= 25 else r.label == a[row, col] * 30)
    wide, _ = tile_rasters(px, 30, 26, 0.0, 0.0, tile=16)
    assert wide.where("pc >= 10 AND label IS NOT NULL AND chip % 2 = 1").count() == 0 and wide.count() == 4 * 256
    assert all(x.count() == 0 for x in tile_rasters(px.where("r < 0"), 30, 26, 0.0, 0.0, tile=13))


def test_geodesic_area(spark):
    """An eighth of the ellipsoid, across the antimeridian too; a small square; a hole; both directions."""
    def ring(part, hole, *corners):
        return [("a", part, 0, hole, *map(float, p + q)) for p, q in zip(corners, corners[1:] + corners[:1])]

    def area(*rings):
        edges = spark.createDataFrame([e for r in rings for e in r], "id string, part int, ring int, hole boolean, x1 double, y1 double, x2 double, y2 double")
        return geodesic_area(edges).first()["area"]
    eighth = 510065621724088.44 / 8
    assert area(ring(0, False, (0, 0), (90, 0), (0, 90))) == pytest.approx(eighth, rel=1e-9)
    assert area(ring(0, False, (150, 0), (150, -90), (-120, 0))) == pytest.approx(eighth, rel=1e-9)
    square = ((10, 45), (10.01, 45), (10.01, 45.01), (10, 45.01))
    s = np.sin(np.radians(45.005))
    w = 1 - 6.69437999014131699614e-3 * s * s
    want = 6378137.0 ** 2 * (1 - 6.69437999014131699614e-3) / w ** 2 * np.cos(np.radians(45.005)) * np.radians(0.01) ** 2
    assert area(ring(0, False, *square)) == pytest.approx(want, rel=1e-6)
    outer = ((9, 44), (11, 44), (11, 46), (9, 46))
    assert area(ring(0, False, *outer), ring(0, True, *square)) == pytest.approx(
        area(ring(0, False, *outer[::-1])) - want, rel=1e-9)


def test_blocks_do_not_show(spark, monkeypatch):
    """Gradients, terrain and box sums are the same however the raster is cut, also left of and above the origin."""
    a = np.random.default_rng(5).random((21, 18))
    df = raster(spark, a).select((F.col("r") - 9).alias("r"), (F.col("c") - 5).alias("c"), "v")

    def rows():
        both = boxcar_and_terrain(df, [], ["v"], 5, "v").join(gradients(df, []).drop("v"), ["r", "c"])
        return sorted(map(tuple, both.select("r", "c", "v", "box_v", "slope", "aspect", "gx", "gy").collect()))
    whole = rows()
    monkeypatch.setattr(focal, "BLOCK", 4)
    assert len(whole) == a.size and rows() == whole


def test_terrain_of_a_plane(spark):
    n, x0, y1 = 8, 584670.0, 550110.0
    df = raster(spark, np.zeros((n, n))).withColumn("v", 0.1 * (F.col("c") + 0.5) * 10)
    x, y = F.lit(x0) + (F.col("c") + 0.5) * 10, F.lit(y1) - (F.col("r") + 0.5) * 10
    sx, sy, rot = terrain_geometry(x, y, F.lit(32650))
    geo = df.select(F.avg(sx), F.avg(sy), F.avg(rot)).first()
    assert geo[0] == pytest.approx(9.99166, abs=2e-4) and geo[1] == pytest.approx(10.05849, abs=2e-4)
    assert geo[2] == pytest.approx(0.0663, abs=2e-4)
    d = df.withColumn("sx", sx).withColumn("sy", sy).withColumn("rot", rot)
    out = terrain(d, [], F.col("sx"), F.col("sy"), F.col("rot")).collect()
    for r in out:
        edge = r["r"] in (0, n - 1) or r["c"] in (0, n - 1)
        assert (r["slope"] is None) == edge
        if not edge:
            assert r["slope"] == pytest.approx(np.degrees(np.arctan(0.1 * 10 / r["sx"]))) and r["aspect"] == pytest.approx(270 - r["rot"])


def test_utm_round_trip_is_exact(spark):
    p = spark.createDataFrame([(584670.0, 550110.0, 32650), (589220.0, 545560.0, 32650), (300000.0, 7390000.0, 32723)], "x double, y double, e int")
    lon, lat = utm_inverse(F.col("x"), F.col("y"), F.col("e"))
    x, y = utm_forward(F.col("lon"), F.col("lat"), F.col("e"))
    for r in p.withColumn("lon", lon).withColumn("lat", lat).withColumn("x2", x).withColumn("y2", y).collect():
        assert abs(r["x"] - r["x2"]) < 1e-6 and abs(r["y"] - r["y2"]) < 1e-6
        assert r["e"] != 32650 or (abs(r["lon"] - 117.8) < 0.05 and abs(r["lat"] - 4.95) < 0.05)


def test_padding_modes(spark):
    for h, w, tile in ((30, 20, 32), (10, 5, 32), (1, 1, 4), (8, 8, 8)):
        a = np.arange(h * w, dtype=float).reshape(h, w)
        ph, pw = -h % tile, -w % tile
        mode = "reflect" if ph < h and pw < w else "symmetric"
        want = np.pad(a, ((0, ph), (0, pw)), mode=mode)
        got = array(pad_tiles(raster(spark, a), h, w, tile), want.shape)
        assert np.array_equal(got, want)


def test_mosaic_layout_off_grid_and_empty(spark):
    def cells(rows):
        return spark.createDataFrame([(str(i), i, float(x), float(y), role) for i, (x, y, role) in enumerate(rows)],
                                     "cell string, ord int, x0 double, y1 double, role string")
    grid = {"x0": 0.0, "y1": 0.0}
    got = mosaic_layout(cells([(2560, -2560, "aoi"), (5120, -2560, "ring"), (2560, -5120, "aoi"), (5120, -5120.0, "aoi"),
                               (0, 0, "ring"), (2560, -2560, "ring")]), grid).collect()
    assert sorted((r["mr"], r["mc"], r["cell"]) for r in got) == [(0, 0, "0"), (0, 1, "1"), (1, 0, "2"), (1, 1, "3")]
    assert mosaic_layout(cells([(0, 0, "ring")]), grid).count() == 0
    with pytest.raises(Exception, match="off the grid"):
        mosaic_layout(cells([(3.0, 0, "aoi")]), grid).collect()


# ------------------------------------------------------------------ tiles
def test_tile_origins(spark):
    for size, tile, overlap in ((100, 256, 32), (256, 256, 32), (600, 256, 32), (704, 256, 32), (41, 16, 5), (17, 16, 0)):
        starts = tile_origins(size, tile, overlap)
        assert starts[0] == 0 and (size <= tile or starts[-1] == size - tile)
        df = spark.range(size).select(F.col("id").alias("r"), covering(F.col("id"), size, tile, overlap).alias("t"))
        for r in df.collect():
            assert sorted(r["t"]) == [s for s in starts if s <= r["r"] < s + tile]


def _pixels(spark, h, w, seed=1):
    a = np.random.default_rng(seed).integers(0, 50, (h, w)).astype(float)
    return raster(spark, a).withColumn("bands", F.array(F.col("v").cast("int")))


def test_blocks_equal_the_whole(spark):
    """A pixel-wise model gives the same map in blocks and as a whole; a tile that is covered once keeps its value."""
    px = _pixels(spark, 70, 60)
    score = lambda df: df.withColumn("p", F.col("v") * 2 + 1)                      # noqa: E731
    mask = px.where((F.col("r") < 20) | (F.col("c") > 45)).select("r", "c")
    whole = array(predict_tiles(px, score, 70, 60, 16, 4), (70, 60), "p")
    blocks = array(predict_blocks(px, mask, score, 70, 60, 16, 8, 16, 4), (70, 60), "p")
    v = array(px, (70, 60))
    assert np.allclose(whole[v > 0], 2 * v[v > 0] + 1) and np.isnan(whole[v == 0]).all()
    inside = np.isfinite(blocks)
    assert np.allclose(blocks[inside], whole[inside])
    want = array(mask.withColumn("v", F.lit(1.0)), (70, 60)) == 1
    assert (inside | (v == 0))[want].all()
    assert np.isnan(blocks[48:64, 16:32]).all()                                    # block without mask pixels


def test_model_sees_whole_tiles(spark):
    sizes = []
    px = _pixels(spark, 40, 30)

    def model(pdf: pd.DataFrame) -> pd.Series:
        return pd.Series(float(len(pdf)), index=pdf.index)
    out = array(predict_tiles(px, tile_scorer(model), 40, 30, 16, 4), (40, 30), "p")
    assert np.nanmin(out) == np.nanmax(out) == 256 and sizes == []


# ------------------------------------------------------------------ accuracy
def test_chip_accuracy_rules(spark):
    px = spark.createDataFrame([(0, 2.0, 1.0), (0, 3.0, 1.01), (0, None, 5.0), (0, 9.0, 80.0), (0, 9.0, 80.1), (0, 1.0, -999.0),
                                (0, 1.0, None), (1, 4.0, 0.5), (2, 5.0, 7.0), (2, 6.0, 7.0)], "chip int, pred double, ref double")
    got = {r["chip"]: r for r in M.chip_accuracy(px).collect()}
    assert set(got) == {0, 2} and got[0]["n"] == 3 and got[2]["r2"] is None
    assert got[0]["me"] == pytest.approx(((3 - 1.01) - 5 + (9 - 80)) / 3)
    s = M.chip_summary(M.chip_accuracy(px)).first()
    assert s["n_chips"] == 2 and s["r2_median"] == pytest.approx(got[0]["r2"]) and s["n_px"] == 5
    assert s["rmse_median"] == pytest.approx((got[0]["rmse"] + got[2]["rmse"]) / 2)
    uncapped = {r["chip"]: r["n"] for r in M.chip_accuracy(px, cap80=False).collect()}
    assert uncapped == {0: 4, 2: 2}


def test_paired_accuracy_of_constants(spark):
    px = spark.createDataFrame([(0, 1.1, float(i)) for i in range(50)] + [(1, float(i), 2.0 * i) for i in range(50)]
                               + [(2, 1.0, 2.0)] + [(3, None, 2.0)], "k int, pred double, ref double")
    got = {r["k"]: r for r in M.paired_accuracy(px, ["k"]).collect()}
    assert got[0]["r2"] is None and got[1]["r2"] == pytest.approx(1.0) and got[1]["r2"] <= 1.0
    assert got[2]["r2"] is None and got[2]["rmse"] == 1.0 and got[3]["n"] == 0 and got[3]["rmse"] is None
    assert {r["k"] for r in M.pooled_accuracy(px, ["k"]).collect()} == {0, 1, 2}


def test_kept_chips_of_the_reference(spark):
    """655 cells above 1 m of 65536 are dropped, 656 are kept; cells of exactly 1 m do not count."""
    def chip(cr, n, extra_one=0):
        return [(cr * 256 + i // 256, i % 256, 5.0 + i % 7 if i < n else 1.0) for i in range(n + extra_one)]
    ref = spark.createDataFrame(chip(0, 656) + chip(1, 655, 300) + chip(2, 3) + chip(3, 0, 50), "r long, c long, v double")
    rows = {r["cr"]: r["kept"] for r in M.chip_keep(ref).collect()}
    assert rows == {0: True, 1: False, 2: False}
    layers = ref.select(F.lit("a").alias("layer"), "r", "c", (F.col("v") + 1).alias("v"))
    out = reference_section(layers, ref.select("r", "c"), ref).collect()
    assert len(out) == 1 and out[0]["n"] == 656 and out[0]["bias"] == pytest.approx(1.0) and out[0]["rmse"] == pytest.approx(1.0)
    assert out[0]["note"] == "1 chips, 2 with too few cells left out"


def test_zonal_percentiles_of_all_pixels(spark):
    a = np.random.default_rng(8).random((100, 100)) * 40
    df = raster(spark, a).withColumn("layer", F.lit("x"))
    row = M.zonal_statistics(df, df).first()
    want = np.percentile(a, [10, 50, 90])
    assert [row["p10"], row["p50"], row["p90"]] == pytest.approx(list(want)) and row["mean"] == pytest.approx(a.mean()) and row["n_px"] == 10_000


def test_too_few_labels(spark):
    px = spark.createDataFrame([(i % 4, 2.0) for i in range(2000)], "chip int, label double")
    with pytest.raises(Exception, match="at least 5"):
        M.require_labels(px).collect()
    assert M.require_labels(px, 4, 2000).first()["ok"]


# ------------------------------------------------------------------ radar
def scene(spark, ids, n=40, vv=0.1, angle=38.0, elev="100.0", month=6, heading=-10.0):
    rows = [(s, v if isinstance(v, float) else 0.1) for s, v in zip(ids, vv if isinstance(vv, list) else [vv] * len(ids))]
    acq = spark.createDataFrame([(s, i, v) for i, (s, v) in enumerate(rows)], "id string, k int, vv double")
    grid = spark.range(n * n).select(F.floor(F.col("id") / n).alias("r"), (F.col("id") % n).alias("c"))
    px = acq.crossJoin(grid).select(
        "id", F.expr(f"timestamp_ntz'2020-{month:02d}-01' + make_dt_interval(k)").alias("t"), F.lit(heading).alias("heading"),
        "r", "c", "vv", F.lit(0.02).alias("vh"), F.lit(1.0).alias("m"),
        F.when(F.col("id") == "edge", 29.0).otherwise(angle).alias("angle"), F.lit(1).alias("foot"),
        F.expr(elev).cast("double").alias("elev"), F.lit(1).alias("tv"))
    return acq, px


def chain(acq, px, members):
    ratios = A.member_ratios(px.select(F.col("id").alias("sid"), "r", "c", "vv", "vh", F.col("m").alias("w")), ["sid"])
    asked = acq.withColumn("members", F.array(*[F.lit(m) for m in members]))
    return A.acquisition_db(px, A.member_join(asked, ratios))


def core(df, n=40, halo=10):
    return df.where(F.col("r").between(halo, n - halo - 1) & F.col("c").between(halo, n - halo - 1))


def test_constant_backscatter(spark):
    acq, px = scene(spark, ["a", "b", "c"])
    rows = core(chain(acq, px, ["a", "b", "c"])).collect()
    assert len(rows) == 3 * 400
    for b, v in (("vv", 0.1), ("vh", 0.02)):
        want = 10 * np.log10(v / np.cos(np.radians(38.0)))
        assert all(abs(r[b] - want) < 1e-5 for r in rows)


def test_masks_and_median(spark):
    acq, px = scene(spark, ["a", "b", "edge"], vv=[0.1, 0.4, 0.1])
    db = core(chain(acq, px, ["a", "b", "edge"])).cache()
    assert db.where("id = 'edge' AND vv IS NOT NULL").count() == 0
    values = {r["id"]: r["vv"] for r in db.where("r = 15 AND c = 15").collect()}
    assert values["b"] - values["a"] == pytest.approx(10 * np.log10(4), abs=1e-5)
    med = A.radar_composite(db).where("band = 'vv'").collect()
    assert all(r["n"] == 2 and r["median"] == pytest.approx((values["a"] + values["b"]) / 2) for r in med)
    assert {r["season"] for r in A.radar_composite(db, seasonal=True).collect()} == {2}
    db.unpersist()


def test_layover(spark):
    for grad, masked in ((0.2, False), (2.0, True)):
        acq, px = scene(spark, ["t"], elev=f"100 + {grad} * 10 * r", heading=0.0)
        rows = core(chain(acq, px, ["t"])).collect()
        flat = 10 * np.log10(0.1 / np.cos(np.radians(38.0)))
        assert all((r["vv"] is None) == masked for r in rows)
        assert masked or all(abs(r["vv"] - flat) > 0.2 for r in rows)


def test_filter_set_of_a_simple_series(spark):
    """Fifteen passes twelve days apart: the ten newest up to the own day; near the start the series is topped up."""
    rows = [(i, i, "IW", 7, 7, ["VV", "VH"], [1, 2]) for i in range(15)]
    rows += [(100, 3, "EW", 7, 7, ["VV", "VH"], [1, 2]), (101, 4, "IW", 8, 8, ["VV", "VH"], [1, 2]),
             (102, 5, "IW", 7, 7, ["HH"], [1, 2]), (103, 6, "IW", 7, 7, ["VV", "VH"], [2, 3])]
    df = spark.createDataFrame(rows, "id long, k int, mode string, orbit_start int, orbit_stop int, pols array<string>, slots array<int>")
    df = df.withColumn("t", F.expr("timestamp_ntz'2020-01-01 05:00:00' + make_dt_interval(12 * k)"))
    got = {r["id"]: r for r in A.filter_sets(df).collect()}
    assert got[14]["members"] == [5, 6, 103, 7, 8, 9, 10, 11, 12, 13, 14] and len(got[14]["dates"]) == 10
    assert got[2]["members"] == [0, 1, 2, 3, 4, 5, 6, 103, 7, 8, 9]
    assert got[102]["members"] == [102]                     # the only one with its polarisation
    assert got[103]["members"] == [6, 103]                  # no other date covers it; all scenes of that date belong
    assert 101 in got[101]["members"] and len(got[101]["members"]) == 1


def test_radar_medians_are_bounded_by_their_acquisitions(spark, monkeypatch):
    """A probe row stands for all acquisitions of a pixel: the limit holds for their number, not for the rows of the probe."""
    db = spark.range(7).select(F.lit("2020-01-01").cast("timestamp_ntz").alias("t"), F.lit(0).alias("r"), F.lit(0).alias("c"),
                               F.col("id").cast("double").alias("vv"), F.col("id").cast("double").alias("vh"))
    seen, whole = [], scale._split_quantiles
    monkeypatch.setattr(scale, "_split_quantiles", lambda df, keys, spec, biggest, limit: seen.append(biggest) or whole(df, keys, spec, biggest, limit))
    pixel = spark.createDataFrame([(0, 0)], "r int, c int")
    for limit, split in ((7, []), (6, [7])):
        out = scale.group_quantiles(db, ["r", "c"], {"m": ("vv", 0.5)}, limit=limit, probe=pixel, probe_each=7).collect()
        assert [r["m"] for r in out] == [3.0] and seen == split
    assert {r["median"] for r in A.radar_composite(db, probe=pixel, acquisitions=7).collect()} == {3.0}


def _passes(spark):
    """Passes of two orbits and three footprints with gaps, many at the same time; frames two tiles apart."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(160):
        f, orbit = int(rng.integers(3)), int(rng.integers(2))
        rows.append((i, int(rng.integers(40)) * (1 + 2 * int(rng.integers(6))) * 3, "IW" if rng.random() < 0.8 else "EW", orbit, orbit if i % 5 else 1 - orbit,
                     ["VV"] if rng.random() < 0.1 else ["VV", "VH"], f, [f, f + 1, f + 2]))
    df = spark.createDataFrame(rows, "id long, h int, mode string, orbit_stop int, orbit_start int, pols array<string>, frame long, slots array<long>")
    return df.withColumn("t", F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, h)")).drop("h")


@pytest.mark.parametrize("area", [False, True])
def test_shared_footprints_give_the_sets_of_single_candidates(spark, area):
    scenes, frames = _passes(spark), None
    if area:
        frames = spark.createDataFrame([(f, *e) for f in range(3) for x in [f * 100.0] for e in (
            (x, 0.0, x + 300, 0.0), (x + 300, 0.0, x + 310, 90.0), (x + 310, 90.0, x + 10, 90.0), (x + 10, 90.0, x, 0.0))], "frame long, x1 double, y1 double, x2 double, y2 double")
    want = {r["id"]: (r["members"], r["dates"]) for r in A._by_position(scenes, 4, 6, frames).collect()}
    got = {r["id"]: (r["members"], r["dates"]) for r in A._by_footprint(scenes, 4, 6, frames, None).collect()}
    assert got == want and len({len(d) for _, d in want.values()}) > 2
    summed = A.filter_sets(scenes, 4, 6, frames, sums={"s": lambda m: m * 3 % 7}).collect()
    assert {r["id"]: (r["members"], r["s"], r["dates"]) for r in summed} == {i: (len(m), sum(x * 3 % 7 for x in m), d) for i, (m, d) in want.items()}


def test_footprints_that_do_not_repeat_fetch_single_candidates(spark, monkeypatch):
    monkeypatch.setattr(A, "SMALL_ROWS", 0)
    own = _passes(spark).withColumn("slots", F.array(F.lit(0).cast("long"), F.col("id") + 1))
    assert A._by_footprint(own, 4, 1, None, None) is None
