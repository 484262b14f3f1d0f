"""Band encodings, filters and scalar functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import encode as enc
from ..functions.calendar import (from_epoch_ms, in_annual_window, in_season, in_seasonal_window, season_of,
                                  seasonal_year)
from ..functions.geodesy import (bearing, fractional_index, haversine, on_grid, pixel_centre, resolution_m,
                                 snap_origin_x, snap_origin_y, utm_forward, utm_inverse, web_mercator)
from ..functions.nodata import decode_label, encode_label, label_in_cap, labelled, null_if_all_zero, to_null
from ..functions.radiometry import (angle_in_range, db_round_trip, from_db, good_quality, pair_valid, qa_clear,
                                    safe_div, slope_towards_sensor, terrain_factor, terrain_visible, to_db)
from ..operators.metrics import over_cap
from .base import EMB, OBS, PAIRS, R, RASTER, Tables, query, rnd

CODE = "CASE WHEN {x} IS NULL OR isnan({x}) THEN 0 ELSE CAST(trunc(least(greatest({x}, 0.0), 65535.0)) AS INT) END"


def _code(x: str) -> str:
    return CODE.format(x=f"CAST({x} AS DOUBLE)")


_RADAR = ("-((id % 60) + 0.345::DOUBLE)", "CASE WHEN id % 10 <> 0 THEN -((id % 70) + 0.5::DOUBLE) END")
ANNUAL = f"""(SELECT id, band, {_code('x')} AS code FROM (
 SELECT id, unnest(range(0, 64)) AS band, (CAST(unnest(embedding) AS DOUBLE) + 1) * 1e4::DOUBLE AS x FROM {EMB}
 UNION ALL SELECT id, 64, CAST((id * 37) % 3100 - 100 AS DOUBLE) FROM {EMB}
 UNION ALL SELECT id, 65, ({_RADAR[0]} + 50.0) * 100.0 FROM {EMB}
 UNION ALL SELECT id, 66, ({_RADAR[1]} + 50.0) * 100.0 FROM {EMB}
 UNION ALL SELECT id, 67 + k, CASE WHEN (id + k) % 13 <> 0 THEN CAST((id * 977 + k * 7919) % 70000 AS DOUBLE) END
  FROM {EMB}, range(0, 9) q(k)))"""
SEASONAL = f"""(SELECT id, band, {_code('x')} AS code FROM (
 SELECT id, k AS band, (-((id * (k + 1)) % 60 + 0.25::DOUBLE) + 50.0) * 100.0 AS x FROM {EMB}, range(0, 8) q(k)
 UNION ALL SELECT id, 8 + k, CASE WHEN (id + k) % 11 <> 0 THEN ((id * 31 + k * 101) % 7000) / 1000.0::DOUBLE * 10000.0 END
  FROM {EMB}, range(0, 36) q(k)))"""


def _k(n: int):
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def coded(t: Tables):
    """Embedding pixels with annual and seasonal codes."""
    i = F.col("id")
    radar = F.array(-((i % 60) + 0.345), F.when(i % 10 != 0, -((i % 70) + 0.5)))
    optical = F.transform(_k(9), lambda k: F.when((i + k) % 13 != 0, ((i * 977 + k * 7919) % 70000).cast("double")))
    radar4 = F.transform(_k(8), lambda k: -((i * (k + 1)) % 60 + 0.25))
    optical4 = F.transform(_k(36), lambda k: F.when((i + k) % 11 != 0, ((i * 31 + k * 101) % 7000) / F.lit(1000.0)))
    dem = ((i * 37) % 3100 - 100).cast("double")
    return t.emb.select("id", "r", "c", "label", enc.encode_annual(F.col("embedding"), dem, radar, optical).alias("annual"),
                        enc.encode_seasonal(radar4, optical4).alias("seasonal"))


def _bands(df, column: str, name: str = "code"):
    return df.select("id", F.posexplode(column).alias("band", name))


@query("B1 B21 B23 X14", f"SELECT id, CAST(band AS INT) AS band, code FROM {ANNUAL}")
def encode_annual(t: Tables):
    return _bands(coded(t), "annual")


@query("B2", f"SELECT id, CAST(band AS INT) AS band, code FROM {SEASONAL}")
def encode_seasonal(t: Tables):
    return _bands(coded(t), "seasonal")


@query("B3 B4", f"""SELECT label, count(*) AS n, count(CASE WHEN label <> -999 THEN 1 END) AS decoded,
 CAST(sum(CASE WHEN label > -900 AND label <> 50 THEN 1 ELSE 0 END) AS BIGINT) AS shown FROM (
 SELECT CAST(CASE WHEN b1 <= 5 THEN -999 WHEN b1 <= 10 THEN -999 ELSE b1 END AS FLOAT) AS label FROM {OBS}) GROUP BY label""")
def encode_label_values(t: Tables):
    raw = F.when(F.col("b1") <= 5, F.lit(-9999.0)).when(F.col("b1") <= 10, F.lit(float("nan"))).otherwise(F.col("b1"))
    px = t.obs.select(encode_label(raw).alias("label"))
    return (px.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count(decode_label(F.col("label"))).alias("decoded"),
                                    F.count(to_null(F.col("label"), 50.0, -900.0)).alias("shown")))


@query("B5", f"""SELECT i AS input, id, CAST(band AS INT) AS band,
  CASE WHEN (band < 64 AND i IN ('A', 'T')) OR (band > 64 AND i IN ('E', 'T', 'TE')) THEN 0 ELSE code END AS code
 FROM {ANNUAL}, (SELECT unnest(['AE', 'A', 'E', 'T', 'TE']) AS i)""")
def unused_layers_zero(t: Tables):
    """Every input: which annual bands survive."""
    one = coded(t).select("id", F.explode(F.array(*[
        F.struct(F.lit(i).alias("input"), enc.unused_as_zero(F.col("annual"), i).alias("x")) for i in ("AE", "A", "E", "T", "TE")])).alias("o"))
    return one.select("o.input", "id", F.posexplode("o.x").alias("band", "code"))


@query("B6 X14", f"""SELECT id, CAST(CASE WHEN band = 64 THEN 0 ELSE band END AS INT) AS band, code FROM {ANNUAL} WHERE band = 64
 UNION ALL SELECT id, CAST(band + 1 AS INT), code FROM {SEASONAL}""")
def assemble_seasonal_input(t: Tables):
    return _bands(coded(t).select("id", enc.assemble("T", F.col("annual"), F.col("seasonal")).alias("x")), "x")


@query("B6", f"""SELECT id, CAST(band AS INT) AS band, code FROM {ANNUAL} WHERE band <= 64
 UNION ALL SELECT id, CAST(band + 65 AS INT), code FROM {SEASONAL}""")
def assemble_full_input(t: Tables):
    return _bands(coded(t).select("id", enc.assemble("TE", F.col("annual"), F.col("seasonal")).alias("x")), "x")


@query("B7 D12", """SELECT n_nationkey AS id, CASE n_nationkey % 7 WHEN 0 THEN 'AE' WHEN 1 THEN 'A' WHEN 2 THEN 'AE'
 WHEN 3 THEN 'A' WHEN 4 THEN 'E' WHEN 5 THEN 'T' ELSE 'TE' END AS input FROM nation""")
def canonical_inputs(t: Tables):
    names = F.array(*[F.lit(x) for x in ("IE", "I", "AE", "A", "E", "T", "TE")])
    return t.read("nation").select(F.col("n_nationkey").alias("id"),
                                   enc.canonical_name(names[F.col("n_nationkey") % 7]).alias("input"))


STATS = f"""(SELECT band, avg(code) AS mean, stddev_pop(code) AS std FROM {ANNUAL} WHERE code <> 0 GROUP BY band)"""


@query("B8 B9 E26", f"""SELECT id, CAST(a.band - 64 AS INT) AS band, {R('(code - mean) / (std + 1e-12)')} AS v FROM {ANNUAL} a JOIN {STATS} s
 ON a.band = s.band WHERE a.band >= 64""")
def normalise_annual(t: Tables):
    from ..operators.metrics import channel_statistics
    px = coded(t)
    stats = channel_statistics(px, "annual")            # one row per band
    ordered = F.sort_array(F.collect_list(F.struct("band", "mean", "std")))
    one = stats.agg(F.struct(F.transform(ordered, lambda s: s["mean"]).alias("m"),
                             F.transform(ordered, lambda s: s["std"]).alias("s")).alias("st")).scalar()
    x = px.withColumn("st", one).select("id", enc.normalise(
        enc.assemble("A", F.col("annual")), enc.channel_vector("A", F.col("st.m"), None, 0),
        enc.channel_vector("A", F.col("st.s"), None, 1), 0, False).alias("x"))
    return _bands(x, "x", "v").withColumn("v", rnd(F.col("v")))


@query("B8 B9", f"""SELECT id, CAST(band AS INT) AS band, {R("CASE WHEN code = 0 THEN 0 WHEN band < 64 THEN code / 10000.0::DOUBLE - 1 ELSE (code - 100.0) / (7.0::DOUBLE + 1e-12) END")} AS v
 FROM (SELECT id, band, code FROM {ANNUAL} WHERE band <= 64 UNION ALL SELECT id, band + 65, code FROM {SEASONAL})""")
def normalise_full_input(t: Tables):
    mean = enc.channel_vector("TE", F.lit(None), F.array_repeat(F.lit(100.0), 45), 0)
    std = enc.channel_vector("TE", F.lit(None), F.array_repeat(F.lit(7.0), 45), 1)
    x = coded(t).select("id", enc.normalise(enc.assemble("TE", F.col("annual"), F.col("seasonal")), mean, std, 64,
                                            True).alias("x"))
    return _bands(x, "x", "v").withColumn("v", rnd(F.col("v")))


@query("B10", f"""SELECT id, CAST(band AS INT) AS band, CASE WHEN band < 64 THEN CAST(((code - 10000) % 65536 + 65536) % 65536 AS INT) ELSE code END AS code
 FROM {ANNUAL}""")
def forest_feature_codes(t: Tables):
    return _bands(coded(t).select("id", enc.forest_features(F.col("annual"), "paper").alias("x")), "x")


@query("B11", f"""SELECT chip, count(ref) AS present, count(CASE WHEN ref <> 0 THEN 1 END) AS nonzero,
 count(CASE WHEN ref > 0 THEN 1 END) AS positive FROM (SELECT chip, CASE WHEN pred IS NULL THEN NULL
 WHEN ref < 8 THEN 0 ELSE ref - 10 END AS ref FROM {PAIRS}) GROUP BY chip""")
def labelled_pixels(t: Tables):
    y = F.when(F.col("pred").isNotNull(), F.when(F.col("ref") < 8, 0).otherwise(F.col("ref") - 10))
    px = t.pairs.select("chip", y.alias("y"))
    return px.groupBy("chip").agg(F.count_if(labelled(F.col("y"))).alias("present"),
                                  F.count_if(labelled(F.col("y"), True)).alias("nonzero"),
                                  F.count_if(F.col("y") > 0).alias("positive"))


@query("B12", f"""SELECT count(CASE WHEN ref > 0 AND ref <= 80 THEN 1 END) AS kept, count(CASE WHEN ref > 80 THEN 1 END) AS over,
 {R('avg(CASE WHEN ref > 0 AND ref <= 80 THEN ref END)')} AS mean FROM {PAIRS}""")
def label_cap(t: Tables):
    mean = t.pairs.where(label_in_cap(F.col("ref"))).agg(F.avg("ref").alias("m")).scalar()
    return over_cap(t.pairs, "ref").select("kept", "over", rnd(mean).alias("mean"))


@query("B13", f"""SELECT id, CASE WHEN bool_or(code <> 0) THEN any_value(label) END AS label FROM (SELECT id, label,
 CASE WHEN id % 20 = 0 THEN 0 ELSE CAST(greatest(0, trunc(CAST(unnest(embedding) AS DOUBLE) * 10 - 2)) AS INT) END AS code FROM {EMB}) GROUP BY id""")
def empty_pixels_null(t: Tables):
    codes = F.transform("embedding", lambda v: F.when(F.col("id") % 20 == 0, 0).otherwise(
        F.greatest(F.lit(0.0), v.cast("double") * 10 - 2).cast("int")))
    return t.emb.select("id", null_if_all_zero(F.col("label"), codes).alias("label"))


@query("B15 B16 B17 B18", f"""SELECT r, c, count(CASE WHEN b1 > 30.63993 AND b1 < 45.23993 AND quality = 1 THEN 1 END) AS angle,
 count(CASE WHEN (CAST(prob * 512 AS BIGINT) & 1024) = 0 AND (CAST(prob * 512 AS BIGINT) & 2048) = 0 THEN 1 END) AS clear,
 count(aux) AS paired,
 count(CASE WHEN quality = 1 AND degrade = 0 THEN 1 END) AS good FROM {OBS} GROUP BY r, c""")
def observation_masks(t: Tables):
    angle = F.when(F.col("quality") == 0, F.lit(-9999.0)).otherwise(F.col("b1"))
    qa = F.round(F.col("prob") * 512).cast("bigint")
    return t.obs.groupBy("r", "c").agg(
        F.count_if(angle_in_range(angle)).alias("angle"), F.count_if(qa_clear(qa)).alias("clear"),
        F.count_if(pair_valid(F.col("aux"), F.col("b2"))).alias("paired"),
        F.count_if(good_quality(F.col("quality"), F.col("degrade"))).alias("good"))


@query("B19", """SELECT c_custkey AS id, (c_custkey % 5 <> 0 AND c_custkey % 7 <> 0
 AND abs((c_custkey % 100) * 0.1 / 10 - round_even((c_custkey % 100) * 0.1 / 10, 0)) * 10 <= 0.01) AS ok FROM customer""")
def rasters_on_grid(t: Tables):
    k = F.col("c_custkey")
    step = F.when(k % 7 == 0, F.lit(10.5)).otherwise(F.lit(10.0))
    x = F.lit(500.0) + (k % 100) * 0.1
    return t.read("customer").select(k.alias("id"), on_grid(k % 5 != 0, step, -step, x, F.lit(1000.0), F.lit(100.0),
                                                            F.lit(2000.0)).alias("ok"))


@query("B25 B21", f"""SELECT r, c, {R("CASE WHEN class > 10 THEN least(greatest((v * 0.01 - 9.2::DOUBLE) / 0.5, 0), 1) END")} AS z FROM {RASTER}""")
def colour_positions(t: Tables):
    v = F.when(F.col("class") > 10, F.col("v") * 0.01)
    return t.raster.select("r", "c", rnd(enc.colour_index(v, 9.2, 9.7)).alias("z"))


@query("X2 X3", f"""SELECT CAST(floor((month(t) % 12) / 3) AS INT) AS season, CAST(year(t) + CASE WHEN month(t) = 12 THEN 1 ELSE 0 END AS INT) AS window_year,
 count(*) AS n, count(CASE WHEN month(t) IN (12, 1, 2) THEN 1 END) AS winter,
 count(CASE WHEN t >= DATE '1997-01-01' AND t < DATE '1997-12-31' THEN 1 END) AS annual,
 count(CASE WHEN t >= DATE '1996-12-01' AND t < DATE '1997-12-01' THEN 1 END) AS seasonal FROM {OBS} GROUP BY 1, 2""")
def season_windows(t: Tables):
    ts = F.col("t")
    return t.obs.groupBy(season_of(ts).alias("season"), seasonal_year(ts).alias("window_year")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(in_season(ts, 0)).alias("winter"),
        F.count_if(in_annual_window(ts, 1997)).alias("annual"),
        F.count_if(in_seasonal_window(ts, 1997)).alias("seasonal"))


@query("X2", f"""SELECT CAST(floor((month(t) % 12) / 3) AS INT) AS season, count(*) AS n FROM (
 SELECT epoch_ms(CAST(value * 1e8 AS BIGINT) * 10) AS t FROM events) GROUP BY 1""")
def season_of_epoch(t: Tables):
    ms = F.round(F.col("value") * 1e8).cast("bigint") * 10
    return t.read("events").groupBy(season_of(from_epoch_ms(ms)).alias("season")).agg(F.count(F.lit(1)).alias("n"))


@query("X4 X5", f"""SELECT CAST(b1 AS INT) AS k, count(*) AS n, {R('avg(CASE WHEN b1 - 5 > 0 THEN 10 * log10(b1 - 5) END)')} AS db,
 {R('avg(pow(10.0, b1 / 10))', 4)} AS lin, {R('avg(CASE WHEN b1 - 5 > 0 THEN b1 - 5 END)', 4)} AS back,
 {R('avg(CASE WHEN prob = 0 THEN 0 ELSE b1 / prob END)')} AS ratio FROM {OBS} GROUP BY 1""")
def decibels(t: Tables):
    v = F.col("b1") - 5
    return t.obs.groupBy(F.col("b1").cast("int").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg(to_db(v))).alias("db"), rnd(F.avg(from_db(F.col("b1"))), 4).alias("lin"),
        rnd(F.round(F.avg(db_round_trip(v)), 3), 4).alias("back"),
        rnd(F.avg(safe_div(F.col("b1"), F.col("prob")))).alias("ratio"))


@query("X6", f"""WITH p AS (SELECT c_custkey AS id, radians((c_custkey * 7) % 360 - 180.0::DOUBLE) AS l1, radians((c_custkey * 3) % 160 - 80.0::DOUBLE) AS f1,
 radians((c_custkey * 7) % 360 - 180.0::DOUBLE + 0.5) AS l2, radians((c_custkey * 3) % 160 - 80.0::DOUBLE + 0.25) AS f2 FROM customer)
 SELECT id, {R('2 * 6371008.8::DOUBLE * asin(sqrt(pow(sin((f2 - f1) / 2), 2) + cos(f1) * cos(f2) * pow(sin((l2 - l1) / 2), 2)))', 3)} AS metres,
 {R('degrees(atan2(sin(l2 - l1) * cos(f2), cos(f1) * sin(f2) - sin(f1) * cos(f2) * cos(l2 - l1)))', 5)} AS bearing FROM p""")
def distances(t: Tables):
    k = F.col("c_custkey")
    lon, lat = ((k * 7) % 360 - 180).cast("double"), ((k * 3) % 160 - 80).cast("double")
    return t.read("customer").select(k.alias("id"), rnd(haversine(lon, lat, lon + 0.5, lat + 0.25), 3).alias("metres"),
                                     rnd(bearing(lon, lat, lon + 0.5, lat + 0.25), 5).alias("bearing"))


@query("X7 X8 X11 X17", f"""SELECT c_custkey AS id, {R('(-8.0 * (c_acctbal - 100) - 1.0 * (-c_acctbal - 50)) / (10.0 * -8.0 - 1.0 * 2.0) - 0.5')} AS u,
 {R('(10.0 * (-c_acctbal - 50) - 2.0 * (c_acctbal - 100)) / (10.0 * -8.0 - 1.0 * 2.0) - 0.5')} AS w,
 {R('100 + (c_custkey + 0.5) * 10')} AS x, {R('50 - (c_custkey + 0.5) * 10')} AS y,
 CAST(floor(c_acctbal / 10 + 0.01::DOUBLE) * 10 AS DOUBLE) AS sx, CAST(ceil(c_acctbal / 10 - 0.01::DOUBLE) * 10 AS DOUBLE) AS sy,
 {R("CASE WHEN c_custkey % 2 = 0 THEN greatest(0.0001 * 111320.0 * cos(radians(c_nationkey * 3)), 0.0001 * 110574.0) ELSE greatest(c_nationkey, 5.0) END", 4)} AS res
 FROM customer""")
def grid_arithmetic(t: Tables):
    k, a = F.col("c_custkey"), F.col("c_acctbal")
    affine = F.array(*[F.lit(float(v)) for v in (10, 1, 100, 2, -8, 50)])
    u, w = fractional_index(affine, a, -a)
    res = resolution_m(F.when(k % 2 == 0, 0.0001).otherwise(F.col("c_nationkey")), F.when(k % 2 == 0, 0.0001).otherwise(5.0),
                       k % 2 == 0, (F.col("c_nationkey") * 3).cast("double"))
    return t.read("customer").select(
        k.alias("id"), rnd(u).alias("u"), rnd(w).alias("w"), rnd(pixel_centre(F.lit(100.0), k)).alias("x"),
        rnd(pixel_centre(F.lit(50.0), k, downwards=True)).alias("y"), snap_origin_x(a).cast("double").alias("sx"),
        snap_origin_y(a).cast("double").alias("sy"), rnd(res, 4).alias("res"))


@query("X9", f"""WITH p AS (SELECT p_partkey AS id, 31 + (p_partkey % 14) AS theta, (p_partkey * 7) % 60 AS slope, (p_partkey * 13) % 360 AS aspect,
 (p_partkey % 40) - 20 AS heading FROM part), a AS (SELECT *, radians(theta) AS th,
 atan(tan(radians(slope)) * cos(radians(heading) + radians(CASE WHEN aspect <= 180 THEN aspect ELSE aspect - 360 END))) AS al FROM p)
 SELECT id, {R('degrees(al)', 4)} AS alpha, {R('tan(pi() / 2 - th + al) / tan(pi() / 2 - th)', 4)} AS scf,
 (al < th AND al > -(pi() / 2 - th)) AS visible FROM a""")
def terrain_correction(t: Tables):
    k = F.col("p_partkey")
    theta = (31 + k % 14).cast("double")
    alpha = slope_towards_sensor(((k * 7) % 60).cast("double"), ((k * 13) % 360).cast("double"),
                                 ((k % 40) - 20).cast("double"), F.lit(True))
    return t.read("part").select(k.alias("id"), rnd(F.degrees(alpha), 4).alias("alpha"),
                                 rnd(terrain_factor(theta, alpha), 4).alias("scf"),
                                 terrain_visible(theta, alpha).alias("visible"))


@query("X13 X15 X16", """SELECT props->>'k' AS k, count(*) AS n, string_agg(DISTINCT event_type, '; ' ORDER BY event_type) AS kinds,
 CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS clicks FROM events GROUP BY 1""")
def json_and_text(t: Tables):
    e = t.read("events").select(F.get_json_object("props", "$.k").alias("k"), "event_type")
    kinds = e.groupBy("k", "event_type").agg(F.count(F.lit(1)).alias("m"))
    # one entry per event type
    agg = kinds.groupBy("k").agg(F.sum("m").alias("n"), F.map_from_entries(F.collect_list(F.struct("event_type", "m"))).alias("h"))
    return agg.select("k", "n", F.concat_ws("; ", F.array_sort(F.map_keys("h"))).alias("kinds"),
                      (F.coalesce(F.try_element_at("h", F.lit("click")), F.lit(0)) / F.col("n")).alias("clicks"))


MERC = "6378137.0::DOUBLE"


@query("F13", f"""SELECT c_custkey AS id, {R(f'radians((c_custkey * 7) % 360 - 180.0::DOUBLE) * {MERC}', 3)} AS mx,
 {R(f'ln(tan(pi() / 4 + radians((c_custkey * 3) % 160 - 80.0::DOUBLE) / 2)) * {MERC}', 3)} AS my FROM customer""")
def project_web_mercator(t: Tables):
    k = F.col("c_custkey")
    mx, my = web_mercator(((k * 7) % 360 - 180).cast("double"), ((k * 3) % 160 - 80).cast("double"))
    return t.read("customer").select(k.alias("id"), rnd(mx, 3).alias("mx"), rnd(my, 3).alias("my"))


# the oracle projects with the older power series of the meridian arc (a different formula, good to a millimetre
# within a zone); the inverse must return the input
UTM_SQL = f"""WITH p AS (SELECT c_custkey AS id, 117.0::DOUBLE + ((c_custkey * 7) % 300 - 150) / 100.0 AS lon, ((c_custkey * 3) % 120 - 60) * 1.0::DOUBLE AS lat FROM customer),
 k AS (SELECT *, radians(lat) AS f, 0.00669437999014131699614::DOUBLE AS e2, 0.00673949674227643495478::DOUBLE AS ep, 6378137.0::DOUBLE AS a, radians(lon - 117) AS dl FROM p),
 q AS (SELECT *, a / sqrt(1 - e2 * pow(sin(f), 2)) AS nu, pow(tan(f), 2) AS tt, ep * pow(cos(f), 2) AS cc, dl * cos(f) AS aa,
  a * ((1 - e2/4 - 3*e2*e2/64 - 5*pow(e2,3)/256 - 175*pow(e2,4)/16384) * f - (3*e2/8 + 3*e2*e2/32 + 45*pow(e2,3)/1024 + 105*pow(e2,4)/4096) * sin(2*f)
   + (15*e2*e2/256 + 45*pow(e2,3)/1024 + 525*pow(e2,4)/16384) * sin(4*f) - (35*pow(e2,3)/3072 + 175*pow(e2,4)/12288) * sin(6*f) + 315*pow(e2,4)/131072 * sin(8*f)) AS m FROM k)
 SELECT id, {R('500000 + 0.9996 * nu * (aa + (1 - tt + cc) * pow(aa,3)/6 + (5 - 18*tt + tt*tt + 72*cc - 58*ep) * pow(aa,5)/120)', 1)} AS x,
 {R('CASE WHEN lat >= 0 THEN 0 ELSE 10000000 END + 0.9996 * (m + nu * tan(f) * (aa*aa/2 + (5 - tt + 9*cc + 4*cc*cc) * pow(aa,4)/24 + (61 - 58*tt + tt*tt + 600*cc - 330*ep) * pow(aa,6)/720))', 1)} AS y,
 {R('lon', 7)} AS lon, {R('lat', 7)} AS lat FROM q"""


@query("F13 X10", UTM_SQL)
def project_utm(t: Tables):
    k = F.col("c_custkey")
    p = t.read("customer").select(k.alias("id"), (F.lit(117.0) + ((k * 7) % 300 - 150) / 100.0).alias("lon"),
                                  ((k * 3) % 120 - 60).cast("double").alias("lat"))
    epsg = F.when(F.col("lat") >= 0, 32650).otherwise(32750)
    x, y = utm_forward(F.col("lon"), F.col("lat"), epsg)
    xy = p.select("id", x.alias("x"), y.alias("y"), epsg.alias("epsg"))
    lon, lat = utm_inverse(F.col("x"), F.col("y"), F.col("epsg"))
    return xy.select("id", rnd(F.col("x"), 1).alias("x"), rnd(F.col("y"), 1).alias("y"), rnd(lon, 7).alias("lon"),
                     rnd(lat, 7).alias("lat"))
