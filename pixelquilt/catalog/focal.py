"""Neighbourhoods, resampling, tiles and halos."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import focal as N
from ..operators.layout import halo_blocks
from ..operators.resample import bilinear, nearest_join
from ..operators.tiles import blend_weight, covering, predict_blocks, predict_tiles, tile_scorer, to_tiles
from .base import R, RASTER, RELIEF, Tables, big, query, rnd

HOLES = f"(SELECT r, c, CASE WHEN class > 8 THEN v + class END AS v FROM {RASTER})"


def _holes(t: Tables):
    return t.raster.select("r", "c", F.when(F.col("class") > 8, F.col("v") + F.col("class")).alias("v"))


@query("G4", f"""SELECT a.r, a.c, {R('sum(coalesce(b.v, 0)) / 225')} AS box FROM {RASTER} a JOIN {HOLES} b
 ON b.r BETWEEN a.r - 7 AND a.r + 7 AND b.c BETWEEN a.c - 7 AND a.c + 7 GROUP BY a.r, a.c""")
def box_filter(t: Tables):
    return N.boxcar(_holes(t), [], ["v"]).select("r", "c", rnd(F.col("box_v")).alias("box"))


@query("G4", f"""SELECT a.r, a.c, {R('sum(coalesce(b.v, 0)) / 225')} AS box FROM {RASTER} a JOIN {HOLES} b
 ON b.r BETWEEN a.r - 7 AND a.r + 7 AND b.c BETWEEN a.c - 7 AND a.c + 7 GROUP BY a.r, a.c""")
def box_filter_sparse(t: Tables):
    px = _holes(t).where("v IS NOT NULL").withColumn("k", F.lit(0))
    dense = N.densify(px, N.extents_of(t.raster.withColumn("k", F.lit(0)), ["k"]), ["k"])
    return N.boxcar(dense, ["k"], ["v"]).select("r", "c", rnd(F.col("box_v")).alias("box"))


SLOPES = f"""(SELECT a.r, a.c, (e.v - w.v) / 2 / 10 AS gx, (n.v - s.v) / 2 / 10 AS gy FROM {HOLES} a
 LEFT JOIN {HOLES} e ON e.r = a.r AND e.c = a.c + 1 LEFT JOIN {HOLES} w ON w.r = a.r AND w.c = a.c - 1
 LEFT JOIN {HOLES} n ON n.r = a.r - 1 AND n.c = a.c LEFT JOIN {HOLES} s ON s.r = a.r + 1 AND s.c = a.c WHERE a.v IS NOT NULL)"""


@query("G5", f"""SELECT r, c, {R('degrees(atan(sqrt(gx * gx + gy * gy)))', 5)} AS slope, {R('(CAST(degrees(atan2(-gx, -gy)) AS DOUBLE) + 720 - 2.5) % 360', 5)} AS aspect
 FROM {SLOPES} WHERE gx IS NOT NULL AND gy IS NOT NULL""")
def terrain_slopes(t: Tables):
    out = N.terrain(_holes(t), [], 10.0, 10.0, 2.5).where("slope IS NOT NULL")
    return out.select("r", "c", rnd(F.col("slope"), 5).alias("slope"), rnd(F.col("aspect"), 5).alias("aspect"))


# source grid of 10 m pixels from (5, -3), target grid of 7 m pixels from (0, 0)
_U, _W = "((t.c + 0.5) * 7 - 5) / 10.0 - 0.5", "(-(t.r + 0.5) * 7 + 3) / -10.0 - 0.5"
AFFINE = [10.0, 0.0, 5.0, 0.0, -10.0, -3.0]


def _affine():
    return F.array(*[F.lit(x) for x in AFFINE])


@query("F2 X7 X8", f"""SELECT t.r, t.c, s.v FROM (SELECT r, c FROM {RASTER}) t JOIN {RELIEF} s
 ON s.r = CAST(round_even({_W}, 0) AS BIGINT) AND s.c = CAST(round_even({_U}, 0) AS BIGINT)""")
def nearest_resample(t: Tables):
    return nearest_join(t.raster.select("r", "c"), t.relief, _affine(), 0.0, 0.0, 7.0).select("r", "c", "v")


MASKED = f"(SELECT r, c, v, CASE WHEN class < 6 THEN 0 WHEN class < 12 THEN 0.4 ELSE 1 END AS m FROM {RASTER})"


@query("F3 X5", f"""SELECT r, c, {R('coalesce(sum(CASE WHEN m > 0 THEN w * v END) / sum(CASE WHEN m > 0 THEN w END), 0)')} AS v,
 {R('round_even(coalesce(sum(w * m), 0) * 255, 0) / 255')} AS m FROM (SELECT q.r, q.c, s.v, CAST(s.m AS DOUBLE) AS m,
  (CASE WHEN dr = 1 THEN w - floor(w) ELSE 1 - (w - floor(w)) END) * (CASE WHEN dc = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) AS w
  FROM (SELECT t.r, t.c, {_U} AS u, {_W} AS w FROM {RASTER} t) q CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(dr, dc)
  LEFT JOIN {MASKED} s ON s.r = floor(q.w) + dr AND s.c = floor(q.u) + dc) GROUP BY r, c""")
def bilinear_resample(t: Tables):
    src = t.raster.select("r", "c", "v", F.when(F.col("class") < 6, 0.0).when(F.col("class") < 12, 0.4).otherwise(1.0).alias("m"))
    out = bilinear(t.raster.select("r", "c"), src, _affine(), 0.0, 0.0, 7.0)
    return out.select("r", "c", rnd(F.col("v")).alias("v"), rnd(F.col("m")).alias("m"))


def _rows(t: Tables) -> int:
    return int(t.raster.agg(F.max("r")).first()[0]) + 1


_ORIG = lambda size, tile, stride: f"CASE WHEN {size} <= {tile} THEN [0::BIGINT] ELSE list_distinct(list_concat(range(0, CAST({size} - {tile} + 1 AS BIGINT), {stride}), [CAST({size} - {tile} AS BIGINT)])) END"
_WT = lambda i: f"least(1.0, least(({i}) + 1, 16 - ({i})) / 6.0)"
TILED = f"""(WITH h AS (SELECT CAST(max(r) + 1 AS BIGINT) AS h FROM {RASTER}),
 tr AS (SELECT unnest({_ORIG('h', 16, 11)}) AS tr FROM h), tc AS (SELECT unnest({_ORIG('50', 16, 11)}) AS tc)
 SELECT p.r, p.c, p.v, p.class, tr.tr, tc.tc, {_WT('p.r - tr.tr')} * {_WT('p.c - tc.tc')} AS w FROM {RASTER} p, tr, tc
 WHERE p.r >= tr.tr AND p.r < tr.tr + 16 AND p.c >= tc.tc AND p.c < tc.tc + 16)"""


@query("F1 X12 U5", f"SELECT r, c, tr, tc, {R('w')} AS w FROM {TILED}")
def tile_layout(t: Tables):
    out = to_tiles(t.raster, _rows(t), 50, 16, 5)
    return out.select("r", "c", *big("tr", "tc"), rnd(F.col("w")).alias("w"))


@query("F1", f"""SELECT tr, count(DISTINCT r) AS n FROM {TILED} GROUP BY tr""")
def tile_starts(t: Tables):
    px = t.raster.select("r").distinct().withColumn("tr", F.explode(covering(F.col("r"), _rows(t), 16, 5)))
    return px.groupBy("tr").agg(F.count(F.lit(1)).alias("n"))


@query("X12", f"""SELECT r, c, {R('least(1.0, least(r % 16 + 1, 16 - r % 16) / 6.0)')} AS w FROM {RASTER}""")
def blend_ramp(t: Tables):
    return t.raster.select("r", "c", rnd(blend_weight(F.col("r") % 16, 16, 5)).alias("w"))


def _px(t: Tables):
    codes = F.array(F.when(F.col("class") > 3, F.col("class")).otherwise(0), F.when(F.col("class") > 3, 7).otherwise(0))
    return t.raster.select("r", "c", "v", codes.alias("bands"))


def _score(df):
    return df.withColumn("p", F.col("v") * (1 + F.col("tr") / 1000) + F.col("tc"))


@query("F4 B13", f"SELECT r, c, {R('CASE WHEN class > 3 THEN p END')} AS p FROM (SELECT r, c, any_value(class) AS class, sum((v * (1 + tr / 1000) + tc) * w) / sum(w) AS p FROM {TILED} GROUP BY r, c)")
def blended_prediction(t: Tables):
    out = predict_tiles(_px(t), _score, _rows(t), 50, 16, 5)
    return out.select("r", "c", rnd(F.col("p")).alias("p"))


@query("F4 U2 B13", f"""SELECT r, c, {R('CASE WHEN class > 3 THEN p END')} AS p FROM (SELECT r, c, any_value(class) AS class, sum((v - m) * w) / sum(w) AS p
 FROM (SELECT *, avg(v) OVER (PARTITION BY tr, tc) AS m FROM {TILED}) GROUP BY r, c)""")
def blended_model_prediction(t: Tables):
    score = tile_scorer(lambda pdf: pdf["v"] - pdf["v"].mean())
    out = predict_tiles(_px(t), score, _rows(t), 50, 16, 5)
    return out.select("r", "c", rnd(F.col("p")).alias("p"))


BLOCKED = f"""WITH h AS (SELECT CAST(max(r) + 1 AS BIGINT) AS h FROM {RASTER}), wanted AS (SELECT DISTINCT CAST(floor(r / 12) AS BIGINT) AS br, CAST(floor(c / 12) AS BIGINT) AS bc FROM {RASTER} WHERE class > 49),
 b AS (SELECT br, bc, greatest(br * 12 - 4, 0) AS r0, greatest(bc * 12 - 4, 0) AS c0, least((br + 1) * 12 + 4, h) - greatest(br * 12 - 4, 0) AS bh,
  least((bc + 1) * 12 + 4, 50) - greatest(bc * 12 - 4, 0) AS bw FROM wanted, h),
 tr AS (SELECT *, unnest({_ORIG('bh', 16, 11)}) AS lr FROM b), tc AS (SELECT *, unnest({_ORIG('bw', 16, 11)}) AS lc FROM tr),
 px AS (SELECT p.r, p.c, p.v, p.class, r0 + lr AS tr, c0 + lc AS tc, {_WT('p.r - r0 - lr')} * {_WT('p.c - c0 - lc')} AS w FROM {RASTER} p JOIN tc
  ON p.r >= br * 12 AND p.r < (br + 1) * 12 AND p.c >= bc * 12 AND p.c < (bc + 1) * 12 AND p.r >= r0 + lr AND p.r < r0 + lr + 16 AND p.c >= c0 + lc AND p.c < c0 + lc + 16)
 SELECT r, c, {R('CASE WHEN any_value(class) > 3 THEN sum((v * (1 + tr / 1000) + tc) * w) / sum(w) END')} AS p FROM px GROUP BY r, c"""


@query("F5 C18", BLOCKED)
def blocked_prediction(t: Tables):
    mask = t.raster.where("class > 49").select("r", "c")
    out = predict_blocks(_px(t), mask, _score, _rows(t), 50, 12, 4, 16, 5)
    return out.select("r", "c", rnd(F.col("p")).alias("p"))


@query("C18", f"""WITH h AS (SELECT max(r) + 1 AS h FROM {RASTER}) SELECT CAST(br AS BIGINT) AS br, CAST(bc AS BIGINT) AS bc, count(*) AS n, count(CASE WHEN floor(r / 12) = br AND floor(c / 12) = bc THEN 1 END) AS core
 FROM {RASTER}, (SELECT unnest(range(0, CAST(floor((h - 1) / 12) + 1 AS BIGINT))) AS br FROM h), (SELECT unnest(range(0, 5)) AS bc)
 WHERE r >= br * 12 - 4 AND r < (br + 1) * 12 + 4 AND c >= bc * 12 - 4 AND c < (bc + 1) * 12 + 4 GROUP BY ALL""")
def block_halos(t: Tables):
    out = halo_blocks(t.raster, 12, 4, _rows(t), 50)
    return out.groupBy("br", "bc").agg(F.count(F.lit(1)).alias("n"), F.count_if("core").alias("core"))
