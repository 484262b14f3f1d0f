"""Block aggregation, land cover, reference heights, colour scales."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.blocks import (block_percentile, block_reduce, class_histogram, display_average, height_p90,
                                height_reference, histogram_share, landcover_shares, off_grid, prepare_reference,
                                unit_check)
from ..operators.metrics import crop_box, scale_display, scale_range, scale_report
from .base import LAYER, R, RASTER, Tables, big, query, rnd


def _blk(n: int) -> str:
    return f"CAST(floor(r / {n}) AS BIGINT) AS r, CAST(floor(c / {n}) AS BIGINT) AS c"


def f32(c, n=4):
    return F.round(c.cast("double"), n)


HOLES = f"(SELECT r, c, CASE WHEN class % 4 <> 0 AND NOT (r < 10 AND c < 10) THEN v END AS v, class FROM {RASTER})"


def _holes(t: Tables):
    keep = (F.col("class") % 4 != 0) & ~((F.col("r") < 10) & (F.col("c") < 10))
    return t.raster.withColumn("v", F.when(keep, F.col("v")))


@query("E5", f"""SELECT {_blk(10)}, round(CAST(CAST(quantile_cont(v, 0.9) AS FLOAT) AS DOUBLE), 4) AS p90,
 round(CAST(CAST(quantile_cont(v, 0.5) AS FLOAT) AS DOUBLE), 4) AS p50 FROM {HOLES} GROUP BY ALL""")
def block_percentiles(t: Tables):
    out = block_percentile(_holes(t), 10, {"p90": 0.9, "p50": 0.5})
    return out.select("r", "c", f32(F.col("p90")).alias("p90"), f32(F.col("p50")).alias("p50"))


@query("E6", f"""SELECT {_blk(10)}, round(CAST(CAST(quantile_cont(CASE WHEN class <> 25 THEN class END, 0.9) AS FLOAT) AS DOUBLE), 4) AS p90
 FROM {RASTER} GROUP BY ALL""")
def fine_height_p90(t: Tables):
    px = t.raster.select("r", "c", F.when(F.col("class") == 25, 255).otherwise(F.col("class")).alias("v"))
    return height_p90(px).select("r", "c", f32(F.col("p90")).alias("p90"))


# two fine rasters of 1 m pixels: source 1 starts 0.3 m east of the grid corner, source 2 covers the gaps of source 1
FINE = f"""(SELECT r, c, arg_min(v, prio) AS v FROM (
 SELECT r, c, v, 1 AS prio FROM {RASTER} WHERE class > 20
 UNION ALL SELECT r, c, v + 5, 2 FROM {RASTER} WHERE class < 40) GROUP BY r, c)"""


def _fine(t: Tables):
    affine = F.when(F.col("prio") == 1, F.array(*[F.lit(float(x)) for x in (1, 0, 1000.3, 0, -1, 2000)])).otherwise(
        F.array(*[F.lit(float(x)) for x in (1, 0, 1000, 0, -1, 2000.2)]))
    one = t.raster.where("class > 20").select(F.lit(1).alias("prio"), "r", "c", "v")
    two = t.raster.where("class < 40").select(F.lit(2).alias("prio"), "r", "c", (F.col("v") + 5).alias("v"))
    return one.unionByName(two).withColumn("affine", affine).withColumn("source", F.concat(F.lit("s"), F.col("prio").cast("string")))


@query("E7 F2 C8", f"""SELECT {_blk(10)}, round(CAST(CAST(quantile_cont(v, 0.9) AS FLOAT) AS DOUBLE), 4) AS p90, round(CAST(CAST(quantile_cont(v, 0.95) AS FLOAT) AS DOUBLE), 4) AS p95
 FROM {FINE} GROUP BY ALL""")
def fine_reference(t: Tables):
    out = prepare_reference(_fine(t), F.col("affine"), 1000.0, 2000.0, 10.0, 10, {"p90": 0.9, "p95": 0.95})
    return out.select("r", "c", f32(F.col("p90")).alias("p90"), f32(F.col("p95")).alias("p95"))


@query("F10 E7 E19 X17 B21", f"""SELECT {_blk(10)}, round(CAST(CAST(quantile_cont(v, 0.9) AS FLOAT) AS DOUBLE) * 0.09, 4) AS v FROM {FINE} GROUP BY ALL""")
def reference_heights(t: Tables):
    fine = _fine(t)
    meta = fine.select("source", "prio", "affine").distinct().select(
        "*", F.lit(1.0).alias("rx"), F.lit(1.0).alias("ry"), F.lit(False).alias("geographic"), F.lit(0.0).alias("lat"))
    out = height_reference(meta, fine.select("source", "r", "c", "v"), 1000.0, 2000.0, scale=0.09)
    return out.select("r", "c", f32(F.col("v")).alias("v"))


@query("F10 F2 C8", f"""SELECT r, c, round(CASE WHEN class > 20 THEN v ELSE v + 5 END * 0.09, 4) AS v FROM {RASTER}""")
def coarse_reference(t: Tables):
    grid = F.array(*[F.lit(float(x)) for x in (10, 0, 1003, 0, -10, 2002)])
    px = _fine(t).drop("affine").withColumn("affine", grid)
    meta = px.select("source", "prio", "affine").distinct().select(
        "*", F.lit(10.0).alias("rx"), F.lit(10.0).alias("ry"), F.lit(False).alias("geographic"), F.lit(0.0).alias("lat"))
    out = height_reference(meta, px.select("source", "r", "c", "v"), 1000.0, 2000.0, scale=0.09)
    return out.select("r", "c", f32(F.col("v")).alias("v"))


@query("B19 F10", """SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 <> 0
 AND abs((c_custkey % 100) * 0.1 / 10 - round_even((c_custkey % 100) * 0.1 / 10, 0)) * 10 > 0.01 OR c_custkey % 5 = 0""")
def rasters_off_grid(t: Tables):
    k = F.col("c_custkey")
    affine = F.array(F.lit(10.0), F.lit(0.0), F.lit(500.0) + (k % 100) * 0.1, F.lit(0.0), F.lit(-10.0), F.lit(1000.0))
    meta = t.read("customer").select(k.alias("id"), (k % 5 != 0).alias("same_crs"), affine.alias("affine"))
    return off_grid(meta, 100.0, 2000.0).select("id")


@query("E8", f"""SELECT {_blk(7)}, {R('avg(v)')} AS mean, max(v) AS top FROM {HOLES} GROUP BY ALL""")
def block_means(t: Tables):
    px = _holes(t)
    return (block_reduce(px, 7).withColumnRenamed("v", "mean").join(
        block_reduce(px, 7, "max").withColumnRenamed("v", "top"), ["r", "c"])
        .select("r", "c", rnd(F.col("mean")).alias("mean"), "top"))


@query("E8", f"""SELECT {_blk(7)}, CASE WHEN 2 * sum(CASE WHEN class > 22 THEN 1 ELSE 0 END) >= count(*) THEN {R('avg(v)')} END AS v
 FROM {RASTER} GROUP BY ALL""")
def display_blocks(t: Tables):
    px = t.raster.withColumn("mask", F.when(F.col("class") > 22, 1).otherwise(0))
    return display_average(px, 7).withColumn("v", rnd(F.col("v")))


LC = f"(SELECT CAST(floor(r / 10) AS BIGINT) AS cell, CASE WHEN class < 6 THEN 80 WHEN class < 11 THEN 50 WHEN class < 40 THEN 10 WHEN class < 45 THEN 20 END AS class FROM {RASTER})"


def _classes(t: Tables):
    k = F.col("class")
    cls = F.when(k < 6, 80).when(k < 11, 50).when(k < 40, 10).when(k < 45, 20)
    return t.raster.select(F.floor(F.col("r") / 10).alias("cell"), cls.alias("class"))


@query("E9", f"""SELECT cell, {', '.join(R(f'sum(CASE WHEN class = {k} THEN 1 ELSE 0 END) / count(class)') + f' AS {n}' for k, n in ((80, 'water'), (50, 'built'), (10, 'tree')))}
 FROM {LC} GROUP BY cell""")
def land_cover(t: Tables):
    out = landcover_shares(_classes(t))
    return out.select("cell", *[rnd(F.col(n)).alias(n) for n in ("water", "built", "tree")])


@query("E9 X15", f"""SELECT cell, {R('sum(CASE WHEN class = 80 THEN 1 ELSE 0 END) / count(class)')} AS water, 0.0::DOUBLE AS snow FROM {LC} GROUP BY cell""")
def land_cover_histogram(t: Tables):
    out = class_histogram(_classes(t))
    return out.select("cell", rnd(histogram_share(F.col("histogram"), 80)).alias("water"),
                      rnd(histogram_share(F.col("histogram"), 70)).alias("snow"))


@query("E18", f"""SELECT {R('greatest(40, quantile_cont(v, 0.99))')} AS vmax FROM {LAYER}""")
def report_scale(t: Tables):
    return scale_report(t.layer).select(rnd(F.col("vmax")).alias("vmax"))


@query("E18", f"""SELECT CAST(greatest(5, ceil(max(q) / 5) * 5) AS DOUBLE) AS vmax FROM (SELECT layer, quantile_cont(v, 0.995) AS q FROM {LAYER} GROUP BY layer)""")
def display_scale(t: Tables):
    return scale_display(t.layer).select(F.col("vmax").cast("double").alias("vmax"))


@query("E18 H7", f"""SELECT CAST(greatest(0, floor(quantile_cont(v, 0.02))) AS DOUBLE) AS vmin,
 CAST(greatest(ceil(quantile_cont(v, 0.98)), greatest(0, floor(quantile_cont(v, 0.02))) + 1) AS DOUBLE) AS vmax FROM {LAYER}""")
def comparison_scale(t: Tables):
    return scale_range(t.layer)


@query("E19", f"""SELECT count(v) AS n, {R('quantile_cont(v, 0.99)')} AS p99, quantile_cont(v, 0.99) <= 100 AS ok FROM {RASTER}""")
def unit_plausibility(t: Tables):
    return unit_check(t.raster).select("n", rnd(F.col("p99")).alias("p99"), "ok")


@query("E27", f"""SELECT layer, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1, {R('avg(v)')} AS mean, {R('median(v)')} AS median
 FROM {LAYER} WHERE v > 20 GROUP BY layer""")
def crop_boxes(t: Tables):
    px = t.layer.withColumn("v", F.when(F.col("v") > 20, F.col("v")))
    return crop_box(px).select("layer", *big("r0", "r1", "c0", "c1"), rnd(F.col("mean")).alias("mean"), rnd(F.col("median")).alias("median"))


