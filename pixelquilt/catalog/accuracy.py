"""Accuracy, zonal statistics, losses, reports."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.focal import gradient_loss, gradients
from ..plans import report as P
from ..plans.incremental import held_out
from .base import GEDI, LAYER, MASK, PAIRS, R, RASTER, RELIEF, Tables, big, query, rnd

D = "(pred - ref)"
R2 = "CASE WHEN var_pop(pred) > 0 AND var_pop(ref) > 0 THEN covar_pop(pred, ref) ** 2 / (var_pop(pred) * var_pop(ref)) END"


def rounded(df, keys, ints, floats, n=6):
    return df.select(*keys, *big(*ints), *[rnd(F.col(c), n).alias(c) for c in floats])


@query("E10", f"""SELECT model, count(*) AS n_px, {R(f'avg{D}')} AS me, {R(f'sqrt(avg({D} * {D}))')} AS rmse, {R(R2)} AS r2
 FROM {PAIRS} WHERE pred IS NOT NULL GROUP BY model""")
def pooled_accuracy(t: Tables):
    return rounded(M.pooled_accuracy(t.pairs, ["model"]), ["model"], ["n_px"], ["me", "rmse", "r2"])


@query("E11 D13", f"""SELECT chip, count(pred) AS n, {R(f'avg{D}')} AS bias, {R(f'sqrt(avg({D} * {D}))')} AS rmse, {R('CASE WHEN count(pred) > 1 AND var_pop(pred) > 1e-9 THEN least(1, covar_pop(pred, ref) ** 2 / (var_pop(pred) * var_pop(CASE WHEN pred IS NOT NULL THEN ref END))) END')} AS r2
 FROM (SELECT chip, CASE WHEN chip % 10 = 3 AND pred IS NOT NULL THEN 7.0 ELSE CASE WHEN chip % 25 <> 4 THEN pred END END AS pred, ref FROM {PAIRS}) GROUP BY chip""")
def paired_accuracy(t: Tables):
    pred = F.when((F.col("chip") % 10 == 3) & F.col("pred").isNotNull(), 7.0).otherwise(
        F.when(F.col("chip") % 25 != 4, F.col("pred")))
    return rounded(M.paired_accuracy(t.pairs.withColumn("pred", pred), ["chip"]), ["chip"], ["n"], ["bias", "rmse", "r2"])


@query("E12", f"""SELECT model, count(*) AS n, {R(R2)} AS r2, {R(f'sqrt(avg({D} * {D}))')} AS rmse, {R(f'avg{D}')} AS bias, {R(f'avg(abs{D})')} AS mae
 FROM {PAIRS} WHERE pred IS NOT NULL GROUP BY model""")
def flat_accuracy(t: Tables):
    return rounded(M.flat_accuracy(t.pairs, ["model"]), ["model"], ["n"], ["r2", "rmse", "bias", "mae"])


EVAL = f"""(SELECT chip, model, coalesce(pred, 0) AS pred, ref FROM {PAIRS} WHERE ref > 1 AND ref <= 80)"""
CHIPS = f"""(SELECT chip, count(*) AS n, sqrt(avg({D} * {D})) AS rmse, avg(abs{D}) AS mae, avg{D} AS me, {R2} AS r2 FROM {EVAL} GROUP BY chip)"""


@query("E13", f"""SELECT chip, n, {', '.join(f'{R(c)} AS {c}' for c in ('rmse', 'mae', 'me', 'r2'))} FROM {CHIPS}""")
def chip_accuracy(t: Tables):
    return rounded(M.chip_accuracy(t.pairs), ["chip"], ["n"], ["rmse", "mae", "me", "r2"])


@query("E13", f"""SELECT chip, count(*) AS n, {R(f'sqrt(avg({D} * {D}))')} AS rmse, {R(f'avg{D}')} AS me FROM (SELECT chip, coalesce(pred, 0) AS pred,
 CASE WHEN ref < 70 THEN ref * 1.5 END AS ref FROM {PAIRS} WHERE ref > 1 AND ref <= 80) WHERE ref IS NOT NULL GROUP BY chip""")
def chip_accuracy_masked(t: Tables):
    px = t.pairs.withColumn("lab", F.col("ref")).withColumn("ref", F.when(F.col("ref") < 70, F.col("ref") * 1.5))
    return rounded(M.chip_accuracy(px, mask_ref="lab"), ["chip"], ["n"], ["rmse", "me"])


@query("E14", f"""SELECT count(*) AS n_chips, {R('median(rmse)')} AS rmse_median, {R('median(mae)')} AS mae_median, {R('median(me)')} AS me_median,
 {R('median(r2)')} AS r2_median, {R('avg(rmse)')} AS rmse_mean FROM {CHIPS}""")
def chip_summary(t: Tables):
    return rounded(M.chip_summary(M.chip_accuracy(t.pairs)), [], ["n_chips"],
                   ["rmse_median", "mae_median", "me_median", "r2_median", "rmse_mean"])


INSIDE = f"(SELECT l.* FROM {LAYER} l JOIN {MASK} m ON l.r = m.r AND l.c = m.c)"
ZONAL = f"""(SELECT layer, count(v) AS n_px, avg(v) AS mean, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.5) AS p50,
 quantile_cont(v, 0.9) AS p90 FROM {INSIDE} GROUP BY layer)"""


@query("E15 G7 B14", f"SELECT layer, n_px, {', '.join(f'{R(c)} AS {c}' for c in ('mean', 'p10', 'p50', 'p90'))} FROM {ZONAL}")
def zonal_statistics(t: Tables):
    return rounded(M.zonal_statistics(t.layer, t.mask), ["layer"], ["n_px"], ["mean", "p10", "p50", "p90"])


@query("E16", f"""SELECT CAST(floor(r / 64) AS BIGINT) AS cr, CAST(floor(c / 64) AS BIGINT) AS cc, count(*) AS n1, count(*) / 4096.0 >= 0.035 AS kept
 FROM {LAYER} WHERE layer = 'R' AND v > 1 GROUP BY ALL""")
def chip_selection(t: Tables):
    return M.chip_keep(t.layer.where("layer = 'R'"), 0.035, 64).select(*big("cr", "cc", "n1"), "kept")


@query("E17", f"""SELECT count(DISTINCT chip) AS chips, count(CASE WHEN ref > 40 THEN 1 END) AS labels, count(DISTINCT chip) >= 5 AND count(CASE WHEN ref > 40 THEN 1 END) >= 1000 AS ok FROM {PAIRS}""")
def label_sufficiency(t: Tables):
    px = t.pairs.select("chip", F.when(F.col("ref") > 40, F.col("ref")).alias("label"))
    return M.require_labels(px).select(*big("chips", "labels"), "ok")


@query("E26", """SELECT CAST(band AS INT) AS band, count(*) AS n, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS std FROM (
 SELECT unnest(range(0, 64)) AS band, trunc(CAST(unnest(embedding) AS DOUBLE) * 10) AS v FROM embeddings) WHERE v <> 0 GROUP BY band""")
def channel_statistics(t: Tables):
    x = t.emb.select(F.transform("embedding", lambda v: (v.cast("double") * 10).cast("int").cast("double")).alias("bands"))
    return rounded(M.channel_statistics(x), ["band"], ["n"], ["mean", "std"])


@query("E29", f"""SELECT count(*) AS px, {R('count(*) * 100.0 / 1e6')} AS area_km2 FROM {MASK}""")
def mask_area(t: Tables):
    return M.area_km2(t.mask).select("px", rnd(F.col("area_km2")).alias("area_km2"))


@query("F11", f"SELECT model, {R(f'avg(sqrt({D} * {D} + 1e-18))')} AS loss FROM {PAIRS} WHERE pred IS NOT NULL GROUP BY model")
def charbonnier_loss(t: Tables):
    px = t.pairs.where("pred IS NOT NULL")
    return M.charbonnier(px, keys=["model"]).select("model", rnd(F.col("loss")).alias("loss"))


AGREE = f"(SELECT CAST(floor(r / 20) * 100 + floor(c / 20) AS BIGINT) AS chip, r, c, v AS pred, v * 0.9 + class AS ref FROM {RASTER})"


def _agree(t: Tables):
    return t.raster.select((F.floor(F.col("r") / 20) * 100 + F.floor(F.col("c") / 20)).alias("chip"), "r", "c", F.col("v").alias("pred"),
                           (F.col("v") * 0.9 + F.col("class")).alias("ref"))


@query("F11 G3", f"""SELECT {R('avg(abs(gx)) + avg(abs(gy))')} AS loss FROM (SELECT lead(pred - ref) OVER (PARTITION BY chip, r ORDER BY c) - (pred - ref) AS gx,
 lead(pred - ref) OVER (PARTITION BY chip, c ORDER BY r) - (pred - ref) AS gy FROM {AGREE})""")
def gradient_agreement(t: Tables):
    return gradient_loss(_agree(t)).select(rnd(F.col("loss")).alias("loss"))


@query("F11 E8", f"""SELECT {R(f'avg(sqrt({D} * {D} + 1e-18))')} AS loss FROM (SELECT chip, floor((r % 20) / 6) AS br, floor((c % 20) / 6) AS bc, avg(pred) AS pred, avg(ref) AS ref
 FROM {AGREE} WHERE r % 20 < 18 AND c % 20 < 18 GROUP BY ALL)""")
def pooled_agreement(t: Tables):
    px = _agree(t).withColumn("r", F.col("r") % 20).withColumn("c", F.col("c") % 20)
    return M.pooled_loss(px, 6, 20).select(rnd(F.col("loss")).alias("loss"))


@query("G3", f"""SELECT r, c, {R('lead(v) OVER (PARTITION BY r ORDER BY c) - v')} AS gx, {R('lead(v) OVER (PARTITION BY c ORDER BY r) - v')} AS gy FROM {RELIEF}""")
def image_gradients(t: Tables):
    return gradients(t.relief, []).select("r", "c", rnd(F.col("gx")).alias("gx"), rnd(F.col("gy")).alias("gy"))


@query("C14 I3", """WITH tr AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'a' ELSE 'b' END AS model, o_custkey AS chip FROM orders),
 va AS (SELECT c_custkey AS chip FROM customer WHERE c_mktsegment = 'BUILDING'), n AS (SELECT count(*) AS n FROM va)
 SELECT m.model, CASE WHEN m.model <> 'c' THEN count(DISTINCT va.chip) END AS overlap, CASE WHEN m.model = 'c' THEN 'unknown' WHEN count(DISTINCT va.chip) = 0 THEN 'held-out'
  WHEN count(DISTINCT va.chip) = max(n.n) THEN 'in-sample' ELSE 'partly in-sample' END AS status
 FROM (VALUES ('a'), ('b'), ('c')) m(model) CROSS JOIN n LEFT JOIN tr ON tr.model = m.model LEFT JOIN va ON va.chip = tr.chip GROUP BY m.model""")
def held_out_status(t: Tables):
    train = t.read("orders").select(
        F.when(F.col("o_orderstatus") == "P", "a").otherwise("b").alias("model"), F.col("o_custkey").alias("chip"))
    val = t.read("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("chip"))
    models = t.spark.createDataFrame([("a",), ("b",), ("c",)], "model string")
    return held_out(train, val, models)


GOOD = f"(SELECT g.r, g.c, g.v FROM {GEDI} g JOIN {MASK} m ON g.r = m.r AND g.c = m.c WHERE g.v > 0 AND g.v <= 80)"


def _report_sql(rows: str) -> str:
    return f"SELECT section, layer, n, {', '.join(f'{R(c)} AS {c}' for c in ('rmse', 'bias', 'r2', 'mean', 'p10', 'p50', 'p90'))}, note FROM ({rows})"


STUDY_SQL = f"""SELECT 'study_area' AS section, z.layer, a.n, a.rmse, a.bias, a.r2, z.mean, z.p10, z.p50, z.p90, '' AS note FROM {ZONAL} z JOIN (
 SELECT i.layer, count(g.v) AS n, sqrt(avg((i.v - g.v) ** 2)) AS rmse, avg(i.v - g.v) AS bias,
  covar_pop(i.v, g.v) ** 2 / (var_pop(CASE WHEN g.v IS NOT NULL THEN i.v END) * var_pop(g.v)) AS r2 FROM {INSIDE} i LEFT JOIN {GOOD} g ON i.r = g.r AND i.c = g.c GROUP BY i.layer) a USING (layer)
 UNION ALL SELECT 'study_area', 'GEDI', count(v), NULL, NULL, NULL, avg(v), quantile_cont(v, 0.1),
  quantile_cont(v, 0.5), quantile_cont(v, 0.9),
  (SELECT CAST(count(*) AS VARCHAR) || ' labels above the cap left out' FROM {GEDI} g JOIN {MASK} m ON g.r = m.r AND g.c = m.c WHERE g.v > 80) FROM {GOOD}"""
ALS = f"(SELECT r, c, v FROM {INSIDE} WHERE layer = 'R')"
REF_CHIPS = f"(SELECT floor(r / 64) AS cr, floor(c / 64) AS cc, count(*) AS n1 FROM {ALS} WHERE v > 1 GROUP BY ALL)"
REF_PX = f"""(SELECT y.layer, x.cr, x.cc, x.v AS ref, coalesce(i.v, 0) AS pred FROM (SELECT *, floor(r / 64) AS cr, floor(c / 64) AS cc FROM {ALS} WHERE v > 1 AND v <= 80) x
 JOIN {REF_CHIPS} k ON k.cr = x.cr AND k.cc = x.cc AND k.n1 / 4096.0 >= 0.018 CROSS JOIN (VALUES ('A'), ('N')) y(layer)
 LEFT JOIN {INSIDE} i ON i.layer = y.layer AND i.r = x.r AND i.c = x.c)"""
ALS_SQL = f"""SELECT 'als' AS section, layer, CAST(sum(n) AS BIGINT) AS n, median(rmse) AS rmse, sum(sd) / sum(n) AS bias, median(r2) AS r2, NULL AS mean, NULL AS p10, NULL AS p50, NULL AS p90,
 CAST(count(*) AS VARCHAR) || ' chips, ' || CAST((SELECT count(*) FROM {REF_CHIPS} WHERE n1 / 4096.0 < 0.018) AS VARCHAR) || ' with too few cells left out' AS note
 FROM (SELECT layer, cr, cc, count(*) AS n, sum{D} AS sd, sqrt(avg({D} * {D})) AS rmse, {R2} AS r2 FROM {REF_PX} GROUP BY ALL) GROUP BY layer"""


def _report(df):
    return df.select("section", "layer", "n", *[rnd(F.col(c)).alias(c) for c in
                                                ("rmse", "bias", "r2", "mean", "p10", "p50", "p90")], "note")


@query("F12 E15 E11 C7", _report_sql(STUDY_SQL))
def study_area_report(t: Tables):
    return _report(P.study_area_section(t.layer, t.mask, t.gedi))


@query("F12 E13 E14 E16 C7", _report_sql(ALS_SQL))
def reference_report(t: Tables):
    ref = t.layer.where("layer = 'R'").select("r", "c", "v")
    return _report(P.reference_section(t.layer.where("layer <> 'R'"), t.mask, ref, 64, 0.018))


@query("F12 I1", _report_sql(f"SELECT * FROM ({STUDY_SQL}) WHERE layer IN ('A', 'N', 'GEDI') UNION ALL SELECT * FROM ({ALS_SQL})"))
def zonal_report(t: Tables):
    ref = t.layer.where("layer = 'R'").select("r", "c", "v")
    return _report(P.zonal_report(t.layer.where("layer <> 'R'"), t.mask, t.gedi, ref, 64, 0.018))


VAL = "(SELECT l_suppkey AS chip, l_orderkey AS r, l_partkey * 10 + l_linenumber AS c, max(l_extendedprice) / 1200 - 2 AS label, avg(l_quantity) AS q, min(l_discount) AS d FROM lineitem GROUP BY ALL)"


@query("F14 C20 I4", f"""SELECT 'gedi_val' AS section, m.model AS layer, count(*) AS n, {R('sqrt(avg((p - label) ** 2))')} AS rmse, {R('avg(p - label)')} AS bias,
 {R('covar_pop(p, label) ** 2 / (var_pop(p) * var_pop(label))')} AS r2 FROM (SELECT *, CASE WHEN model = 'm1' THEN q ELSE q * 1.2 + 3 END AS p FROM {VAL}, (VALUES ('m1'), ('m2')) x(model) WHERE d > 0) m
 WHERE chip IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000) AND label > 0 AND label <= 80 GROUP BY m.model""")
def validation_report(t: Tables):
    px = t.read("lineitem").groupBy(F.col("l_suppkey").alias("chip"), F.col("l_orderkey").alias("r"),
                                    (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("c")).agg(
        (F.max("l_extendedprice") / 1200 - 2).alias("label"), F.avg("l_quantity").alias("q"), F.min("l_discount").alias("d"))
    p = F.when(F.col("d") > 0, F.when(F.col("model") == "m1", F.col("q")).otherwise(F.col("q") * 1.2 + 3))
    preds = px.withColumn("model", F.explode(F.array(*[F.lit(m) for m in ("m1", "m2", "m3")]))).select(
        "model", "chip", "r", "c", p.alias("pred"))
    val = t.read("supplier").where("s_acctbal < 2000").select(F.col("s_suppkey").alias("chip"))
    currency = t.spark.createDataFrame([("m1", True, ""), ("m2", True, ""), ("m3", False, "old")],
                                       "model string, current boolean, reason string")
    return P.validation_section(preds, val, px, currency).select("section", "layer", "n", *[
        rnd(F.col(c)).alias(c) for c in ("rmse", "bias", "r2")])


_LABELS = "(SELECT l_suppkey AS chip, l_orderkey AS r, l_partkey * 10 + l_linenumber AS c, max(l_extendedprice) / 900 - 2 AS label, avg(l_quantity) AS q, min(l_discount) AS d FROM lineitem GROUP BY ALL)"
_SPLITS = """(SELECT x.model, s_suppkey + x.more AS chip, CASE WHEN s_suppkey % x.k = 0 THEN 'val' ELSE 'train' END AS part
 FROM supplier, (VALUES ('m1', 5, 0), ('m2', 3, 0), ('m4', 4, 1)) x(model, k, more))"""
_FITTED = [("m1", True, ""), ("m2", True, ""), ("m3", False, "older than the stack"), ("m4", True, ""), ("m5", True, ""), ("m6", True, "")]


def _scoring(t: Tables, main: str):
    px = t.read("lineitem").groupBy(F.col("l_suppkey").alias("chip"), F.col("l_orderkey").alias("r"),
                                    (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("c")).agg(
        (F.max("l_extendedprice") / 900 - 2).alias("label"), F.avg("l_quantity").alias("q"), F.min("l_discount").alias("d"))
    currency = t.spark.createDataFrame(_FITTED, "model string, current boolean, reason string")
    preds = px.withColumn("model", F.explode(F.array(*[F.lit(m) for m, _, _ in _FITTED]))).select(
        "model", "chip", "r", "c", F.when(F.col("d") > 0, F.col("q") + F.substring("model", 2, 1).cast("int")).alias("pred"))
    chips = t.read("supplier").select(F.col("s_suppkey").alias("k"))

    def split(model, k, more):
        return chips.select(F.lit(model).alias("model"), (F.col("k") + more).alias("chip"), F.when(F.col("k") % k == 0, "val").otherwise("train").alias("part"))
    splits = split("m1", 5, 0).unionByName(split("m2", 3, 0)).unionByName(split("m4", 4, 1))
    return P.validation_scoring(preds, px, currency, splits, split("", 7, 0).drop("model"), chips.agg(F.count(F.lit(1))).scalar(), main, ("m6",))


def _scoring_sql(val: str) -> str:
    return f"""WITH val AS ({val}), lab AS (SELECT * FROM {_LABELS} WHERE chip IN (SELECT chip FROM val)),
 acc AS (SELECT model, count(*) AS n, sqrt(avg((q + k - label) ** 2)) AS rmse, avg(q + k - label) AS bias, corr(q, label) ** 2 AS r2
  FROM lab, (VALUES ('m1', 1), ('m2', 2), ('m5', 5), ('m6', 6)) x(model, k) WHERE d > 0 AND label > 0 AND label <= 80 GROUP BY model),
 own AS (SELECT model, count(*) FILTER (part = 'train' AND chip IN (SELECT chip FROM val)) AS own FROM {_SPLITS} WHERE model IN ('m1', 'm2') GROUP BY model)
 SELECT m.model AS layer, n, {R('rmse')} AS rmse, {R('bias')} AS bias, {R('r2')} AS r2, own, CASE WHEN m.model = 'm3' THEN 'older than the stack'
  WHEN m.model = 'm4' THEN 'split beyond the stack' WHEN m.model = 'm6' THEN 'in-sample' WHEN own IS NULL THEN 'unknown' WHEN own = 0 THEN 'held-out'
  WHEN own = (SELECT count(*) FROM val) THEN 'in-sample' ELSE 'partly in-sample' END AS note
 FROM (VALUES ('m1'), ('m2'), ('m3'), ('m4'), ('m5'), ('m6')) m(model) LEFT JOIN acc ON acc.model = m.model LEFT JOIN own ON own.model = m.model"""


@query("F14 C20", _scoring_sql("SELECT s_suppkey AS chip FROM supplier WHERE s_suppkey % 3 = 0"))
def validation_scores(t: Tables):
    """The main model is current: its split decides."""
    return _scoring(t, "m2")[0].select("layer", "n", *[rnd(F.col(c)).alias(c) for c in ("rmse", "bias", "r2")], "own", "note")


@query("F14", _scoring_sql("SELECT s_suppkey AS chip FROM supplier WHERE s_suppkey % 7 = 0"))
def validation_scores_by_recipe(t: Tables):
    """The main model's split does not fit the stack: the recipe's decides."""
    return _scoring(t, "m4")[0].select("layer", "n", *[rnd(F.col(c)).alias(c) for c in ("rmse", "bias", "r2")], "own", "note")


@query("F14", f"""SELECT (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 0) AS n_chips, count(*) FILTER (label > 0 AND label <= 80) AS n_labels,
 count(*) FILTER (label > 80) AS n_over FROM {_LABELS} WHERE chip % 3 = 0""")
def validation_labels(t: Tables):
    return _scoring(t, "m2")[1]


@query("C7", """SELECT n_name AS layer, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'not on the mosaic grid, left out' END AS note FROM nation WHERE n_nationkey > 0""")
def layers_on_mosaic_grid(t: Tables):
    n = F.col("n_nationkey")
    meta = t.read("nation").select(F.when(n == 0, "mask").otherwise(F.col("n_name")).alias("layer"),
                                   F.when(n % 3 == 0, 32650).otherwise(32651).alias("epsg"), F.lit(0.0).alias("x0"),
                                   F.lit(0.0).alias("y1"), F.lit(512).alias("width"), F.lit(1024).alias("height"))
    return P.on_mosaic_grid(meta)
