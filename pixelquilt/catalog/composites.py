"""Temporal composites and overlays."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.composite import (acquisition_counts, annual_optical, counted_median, drop_built_up, embedding_median,
                                   first_source, join_masks, label_median, last_on_top, seasonal_optical, set_sums,
                                   with_gaps)
from .base import OBS, R, RASTER, SCENE, Tables, big, query, rnd

MASKED = f"""(SELECT o.*, s.cloud FROM {OBS} o JOIN (SELECT sid, arg_min(cloud, t) AS cloud FROM {SCENE} GROUP BY sid) s USING (sid))"""


def _masked(t: Tables):
    return join_masks(t.obs, t.scene.select("sid", "cloud", "t").withColumnRenamed("t", "_t"), "sid", ["_t"]).drop("_t")


VALID_SQL = "aux IS NOT NULL AND (CAST(prob * 512 AS BIGINT) & 3072) = 0"


def _valid():
    from ..functions.radiometry import pair_valid, qa_clear
    edge = pair_valid(F.col("aux"), F.col("b1"))
    return edge & qa_clear(F.round(F.col("prob") * 512).cast("bigint"))


@query("E1 C4 B16 B17 X3", f"""SELECT r, c, {R('median(b1)')} AS b1, {R('median(b2)')} AS b2 FROM {MASKED}
 WHERE t >= DATE '1997-01-01' AND t < DATE '1997-12-31' AND cloud < 40 AND prob < 20 AND {VALID_SQL} GROUP BY r, c""")
def annual_composite(t: Tables):
    out = annual_optical(_masked(t), 1997, ["r", "c"], ["b1", "b2"], _valid(), probe=t.obs)
    return out.select("r", "c", rnd(F.col("b1")).alias("b1"), rnd(F.col("b2")).alias("b2"))


SEASONAL_SQL = f"""SELECT r, c, CAST(floor((month(t) % 12) / 3) AS INT) AS season, median(b1) / 10000 AS b1,
 median(b2) / 10000 AS b2 FROM {MASKED} WHERE t >= DATE '1996-12-01' AND t < DATE '1997-12-01' AND cloud < 50
 AND prob < 50 AND {VALID_SQL} GROUP BY ALL"""


def _seasonal(t: Tables):
    return seasonal_optical(_masked(t), 1997, ["r", "c"], ["b1", "b2"], _valid(), probe=t.obs)


@query("E2 C4 X2 B2", f"""SELECT r, c, season, CAST(trunc(least(b1 * 10000, 65535)) AS INT) AS code1, {R('b2', 8)} AS b2 FROM ({SEASONAL_SQL})""")
def seasonal_composite(t: Tables):
    code = F.least(F.col("b1") * 10000, F.lit(65535.0)).cast("int")
    return _seasonal(t).select("r", "c", "season", code.alias("code1"), rnd(F.col("b2"), 8).alias("b2"))


@query("F15 E2", f"""SELECT g.r, g.c, CAST(q.season AS INT) AS season, {R('b1', 8)} AS b1 FROM {RASTER} g CROSS JOIN range(0, 4) q(season)
 LEFT JOIN ({SEASONAL_SQL}) s ON s.r = g.r AND s.c = g.c AND s.season = q.season""")
def composite_with_gaps(t: Tables):
    return with_gaps(_seasonal(t), t.raster, ["r", "c"]).select("r", "c", "season", rnd(F.col("b1"), 8).alias("b1"))


@query("E2", f"""SELECT r, c, {', '.join(f"max(CASE WHEN season = {k} THEN {R('b2', 8)} END) AS s{k}" for k in range(4))}
 FROM ({SEASONAL_SQL}) GROUP BY r, c""")
def seasonal_pivot(t: Tables):
    wide = _seasonal(t).groupBy("r", "c").pivot("season", [0, 1, 2, 3]).agg(F.max("b2"))
    return wide.select("r", "c", *[rnd(F.col(str(k)), 8).alias(f"s{k}") for k in range(4)])


@query("E3 B23", """SELECT label, CAST(band AS INT) AS band, round(median(v), 6) + 0.0 AS v FROM (SELECT label, unnest(range(0, 64)) AS band,
 CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY ALL""")
def embedding_composite(t: Tables):
    out = embedding_median(t.emb, ["label"])
    return out.select("label", F.posexplode("embedding").alias("band", "v")).withColumn("v", rnd(F.col("v")))


@query("E4 C10 B18", f"""SELECT r, c, {R("CASE WHEN class <> 50 THEN label END")} AS label FROM (SELECT r, c, median(b1) AS label FROM {OBS}
 WHERE t >= DATE '1996-01-01' AND t < DATE '1999-12-31' AND quality = 1 AND degrade = 0 GROUP BY r, c)
 JOIN (SELECT r, c, CASE WHEN class % 5 = 0 THEN 50 WHEN class > 1 THEN class END AS class FROM {RASTER}) USING (r, c)""")
def label_composite(t: Tables):
    cover = t.raster.select("r", "c", F.when(F.col("class") % 5 == 0, 50).when(F.col("class") > 1, F.col("class")).alias("class"))
    out = label_median(t.obs, "1996-01-01", "1999-12-31", ["r", "c"], "b1", cover)
    return out.withColumn("label", rnd(F.col("label")))


@query("C10", f"""SELECT r, c, CASE WHEN class % 10 <> 0 THEN v END AS label FROM {RASTER}""")
def built_up_mask(t: Tables):
    labels = t.raster.select("r", "c", F.col("v").alias("label"))
    cover = t.raster.select("r", "c", F.when(F.col("class") % 10 == 0, 50).otherwise(F.col("class")).alias("class"))
    return drop_built_up(labels, cover, ["r", "c"])


@query("C8", f"""SELECT r, c, arg_min(b1, (epoch(t)::BIGINT, b2)) AS v FROM {OBS} WHERE prob > 3 GROUP BY r, c""")
def overlay_first(t: Tables):
    px = t.obs.withColumn("v", F.when(F.col("prob") > 3, F.col("b1"))).withColumn("prio", F.struct("t", "b2"))
    return first_source(px, ["r", "c"], "v", "prio")


@query("C9", f"""SELECT r, c, arg_max(b1, (epoch(t)::BIGINT, b2)) AS v FROM {OBS} WHERE prob > 3 GROUP BY r, c""")
def mosaic_last(t: Tables):
    px = t.obs.withColumn("v", F.when(F.col("prob") > 3, F.col("b1"))).withColumn("prio", F.struct("t", "b2"))
    return last_on_top(px, ["r", "c"], "v", "prio")


HIST = """SELECT l_suppkey * 10 + l_linenumber AS k, count(*) AS n, round(median(l_extendedprice), 5) + 0.0 AS median
 FROM lineitem GROUP BY 1"""


@query("E23 U3", HIST)
def histogram_medians(t: Tables):
    v = t.read("lineitem").select((F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("k"),
                                  F.col("l_extendedprice").alias("v"))
    return counted_median(v, ["k"], "v").select("k", "n", rnd(F.col("median"), 5).alias("median"))


@query("E24", f"""SELECT r, c, {R('sum(b1 * prob)', 4)} AS isum, count(CASE WHEN prob > 0 THEN 1 END) AS cnt FROM {OBS} GROUP BY r, c""")
def filter_set_sums(t: Tables):
    return set_sums(t.obs, ["r", "c"], "b1", "prob").select("r", "c", rnd(F.col("isum"), 4).alias("isum"), "cnt")


@query("E25 X2", f"""SELECT r, c, CAST(floor((month(t) % 12) / 3) AS INT) AS season, count(DISTINCT sid) AS acquisitions,
 count(DISTINCT CASE WHEN prob > 4 THEN sid END) AS with_data FROM {OBS} GROUP BY ALL""")
def acquisitions_per_season(t: Tables):
    px = t.obs.withColumn("v", F.when(F.col("prob") > 4, F.col("b1")))
    return acquisition_counts(px, ["r", "c"]).select("r", "c", "season", *big("acquisitions", "with_data"))
