"""Sources and sinks."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geodesy import utm_epsg, utm_forward
from ..operators.layout import chips_of, kept_chips, mosaic_layout, pad_tiles, place_cells, tile_rasters
from ..operators.metrics import paired_accuracy
from ..plans.cells import upsert_landcover
from ..schema import METRIC_COLUMNS
from ..session import fresh_path
from ..sources.geojson import cells_to_geojson, scan_polygons, scan_regions
from ..sources.layers import check_grid, clip_to_cells, scan_cells, scan_chips, scan_layer, scan_observations
from ..sources.sinks import (chip_table, materialise_map, summary_json, train_index, write_metrics_csv, write_mosaic,
                             write_train_stack)
from .base import CELLS, EDGES, MASK, OBS, PAIRS, R, RASTER, Tables, big, query, rnd

ROLE_SQL = "CASE WHEN col BETWEEN 2 AND 3 OR (col BETWEEN 2 AND 6 AND row <= 1) THEN 'aoi' ELSE 'ring' END"
STACK_CELLS = """(SELECT 'cell' || CAST(s_suppkey AS VARCHAR) AS cell, s_acctbal, s_suppkey,
 row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS chip FROM supplier WHERE s_acctbal > 0)"""
STACK_PX = """(SELECT 'cell' || CAST(l_suppkey AS VARCHAR) AS cell, l_linenumber AS r, l_partkey % 8 AS c,
 CAST(max(l_quantity) AS INT) AS a, CASE WHEN min(l_quantity) > 5 THEN min(l_quantity) END AS label
 FROM lineitem GROUP BY ALL)"""


def _layer_px(t: Tables):
    """Raster values as two bands of three layers."""
    base = t.raster.select(
        F.concat(F.lit("cell"), F.floor(F.col("r") / 8).cast("string")).alias("cell"), F.col("r").cast("int").alias("r"),
        F.col("c").cast("int").alias("c"), "v", "class",
        F.element_at(F.array(F.lit("DEM"), F.lit("S1"), F.lit("S2")), F.col("class") % 3 + 1).alias("layer"))
    pairs = F.array(F.struct(F.lit("VV").alias("band"), F.col("v").alias("v")),
                    F.struct(F.lit("VH").alias("band"), (F.col("v") / 2).alias("v")))
    return base.select("cell", "r", "c", "layer", F.explode(pairs).alias("_p")).select("cell", "r", "c", "_p.*", "layer")


@query("A1 A17", f"""SELECT 'cell' || CAST(CAST(floor(r / 8) AS BIGINT) AS VARCHAR) AS cell, count(*) AS n,
 {R('sum(v / 2)', 4)} AS total FROM {RASTER} WHERE class % 3 = 1 AND floor(r / 8) IN (SELECT floor(r / 8) FROM {RASTER} WHERE v > 950) GROUP BY 1""")
def scan_one_layer(t: Tables):
    path = fresh_path(t.spark, "layers")
    _layer_px(t).write.partitionBy("layer").parquet(path)
    px = scan_layer(t.spark, path, "S1", ["VH"])
    cells = t.raster.where("v > 950").select(F.concat(F.lit("cell"), F.floor(F.col("r") / 8).cast("string")).alias("cell"))
    return clip_to_cells(px, cells).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("v"), 4).alias("total"))


@query("A2", """WITH px AS (SELECT CAST(floor(p_partkey / 100) AS BIGINT) AS k, p_partkey AS p FROM part
  WHERE NOT (p_size = 50 AND p_type = 'ECONOMY')),
 cell AS (SELECT k, count(*) AS n FROM px GROUP BY k)
 SELECT 'cell' || CAST(k AS VARCHAR) AS cell, 'S1' AS layer, CASE WHEN n <> 100 THEN 'not one whole cell'
  WHEN k % 11 = 0 THEN 'origin' WHEN k % 13 = 0 THEN 'epsg' WHEN k % 5 = 0 THEN 'bands' END AS reason FROM cell
 WHERE n <> 100 OR k % 11 = 0 OR k % 13 = 0 OR k % 5 = 0""")
def check_layer_grid(t: Tables):
    whole = t.read("part").where("NOT (p_size = 50 AND p_type = 'ECONOMY')")
    p = whole.select(F.floor(F.col("p_partkey") / 100).alias("k"), F.col("p_partkey").alias("p"))
    shift = F.when(F.col("k") % 11 == 0, 5.0).otherwise(0.0)
    r, c = F.floor(F.col("p") % 100 / 10), F.col("p") % 10
    name = F.concat(F.lit("cell"), F.col("k").cast("string"))
    px = p.select(name.alias("cell"), F.lit("S1").alias("layer"), r.alias("r"), c.alias("c"),
                  F.when(F.col("k") % 5 == 0, "HH").otherwise("VV").alias("band"),
                  F.when(F.col("k") % 13 == 0, 32651).otherwise(32650).alias("epsg"),
                  (F.col("k") * 100.0 + shift + (c + 0.5) * 10).alias("x"), (-(r + 0.5) * 10.0).alias("y"))
    cells = p.select(name.alias("cell"), (F.col("k") * 100.0).alias("x0"), F.lit(0.0).alias("y1"),
                     F.lit(32650).alias("epsg")).distinct()
    return check_grid(px, cells, {"S1": ["VV"]}, size=10)


@query("A3", """SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS ord, 'cell' || CAST(s_suppkey AS VARCHAR) AS cell,
 CASE WHEN s_suppkey % 3 = 0 THEN 'aoi' ELSE 'ring' END AS role,
 coalesce(lower(trim(CASE s_suppkey % 6 WHEN 0 THEN 'True' WHEN 1 THEN ' yes ' WHEN 2 THEN '0' WHEN 3 THEN '1.0'
  WHEN 4 THEN 'false' END)) IN ('true', '1', '1.0', 'yes'), false) AS use FROM supplier""")
def scan_cell_plan(t: Tables):
    from ..scale import numbered
    s = F.col("s_suppkey")
    text = F.element_at(F.array(F.lit("True"), F.lit(" yes "), F.lit("0"), F.lit("1.0"), F.lit("false"),
                                F.lit(None)), (s % 6 + 1).cast("int"))
    plan = t.read("supplier").select(
        s, F.concat(F.lit("cell"), s.cast("string")).alias("cell"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y1"),
        F.lit(0).alias("col"), F.lit(0).alias("row"), F.when(s % 3 == 0, "aoi").alias("role"), F.lit(0).alias("dist_m"),
        F.lit(0.0).alias("water"), F.lit(0.0).alias("built"), F.lit(0.0).alias("tree"), text.alias("use"))
    path = fresh_path(t.spark, "cells")
    plan.orderBy("s_suppkey").drop("s_suppkey").coalesce(1).write.option("header", True).csv(path)
    return numbered(scan_cells(t.spark, path).drop("ord"), [F.substring("cell", 5, 9).cast("long")]).select(
        big("ord")[0], "cell", "role", "use")


@query("A4", """WITH k AS (SELECT c_custkey AS k, CAST(floor(sqrt(c_custkey)) AS BIGINT) AS part FROM customer),
 parts AS (SELECT part, count(*) AS n FROM k GROUP BY part)
 SELECT k.part, k.k - k.part * k.part AS row_in_part,
  CAST((SELECT coalesce(sum(n), 0) FROM parts p WHERE p.part < k.part) + k.k - k.part * k.part AS BIGINT) AS chip
 FROM k WHERE k.k >= 100 AND k.k < 900""")
def scan_chip_slice(t: Tables):
    part = F.floor(F.sqrt("c_custkey"))
    chips = t.read("customer").select(part.alias("part"), (F.col("c_custkey") - part * part).alias("row_in_part"))
    return scan_chips(chips, 100, 900).select(*big("part", "row_in_part", "chip"))


@query("A5 X16 I1", f"SELECT id, part, seq, x1, y1, x2, y2 FROM {EDGES}")
def scan_area_polygons(t: Tables):
    edges = scan_polygons(t.area_docs)
    return edges.select("id", F.when(F.col("part").startswith("0."), 0).otherwise(1).alias("part"), "seq",
                        "x1", "y1", "x2", "y2")


@query("A6", f"""SELECT r, c, count(*) AS n FROM {OBS} WHERE t >= TIMESTAMP '1997-01-01' AND t < TIMESTAMP '1997-12-31'
 AND r BETWEEN 3 AND 20 AND c BETWEEN 10 AND 40 GROUP BY r, c""")
def scan_window(t: Tables):
    return (scan_observations(t.obs, "1997-01-01", "1997-12-31", (3, 20, 10, 40)).groupBy("r", "c")
            .agg(F.count(F.lit(1)).alias("n")))


def _stack_inputs(t: Tables):
    name = F.concat(F.lit("cell"), F.col("s_suppkey").cast("string"))
    cells = t.read("supplier").select(name.alias("cell"), "s_suppkey", "s_acctbal", (F.col("s_acctbal") > 0).alias("use"))
    low = F.min("l_quantity")
    px = (t.read("lineitem").groupBy(F.concat(F.lit("cell"), F.col("l_suppkey").cast("string")).alias("cell"),
                                     F.col("l_linenumber").alias("r"), (F.col("l_partkey") % 8).alias("c"))
          .agg(F.array(F.max("l_quantity").cast("int")).alias("annual"), F.when(low > 5, low).alias("label")))
    return chip_table(cells, [F.desc("s_acctbal"), "s_suppkey"], 20), px


@query("A7 G2", f"""SELECT s.chip, CAST(floor(s.chip / 20) + 1 AS BIGINT) AS part, s.chip % 20 AS row_in_part, s.cell,
 count(*) AS n, CAST(sum(p.a) AS BIGINT) AS total, count(p.label) AS gedi_px
 FROM {STACK_CELLS} s JOIN {STACK_PX} p USING (cell) GROUP BY ALL""")
def train_stack(t: Tables):
    chips, px = _stack_inputs(t)
    path = fresh_path(t.spark, "stack")
    write_train_stack(px, chips, path)
    back = t.spark.read.parquet(path)
    per = back.groupBy("chip", "part", "row_in_part", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("annual")[0]).alias("total"), F.count("label").alias("gedi_px"))
    return per.select(*big("chip", "part", "row_in_part"), "cell", *big("n", "total", "gedi_px"))


@query("A7 G2", f"""SELECT s.chip, s.cell, CAST(coalesce((SELECT count(label) FROM {STACK_PX} p WHERE p.cell = s.cell), 0)
 AS BIGINT) AS gedi_px FROM {STACK_CELLS} s""")
def train_chip_index(t: Tables):
    chips, px = _stack_inputs(t)
    return train_index(chips, px).select(big("chip")[0], "cell", big("gedi_px")[0])


def _mosaic_cells(t: Tables):
    return t.cells.withColumn("role", F.expr(ROLE_SQL))


@query("E28", f"""WITH x AS (SELECT cell, ord, col, row, {ROLE_SQL} AS role FROM {CELLS}),
 b AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM x WHERE role = 'aoi')
 SELECT CAST(row - r0 AS BIGINT) AS mr, CAST(col - c0 AS BIGINT) AS mc, min_by(cell, ord) AS cell FROM x, b
 WHERE row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1 GROUP BY 1, 2""")
def mosaic_positions(t: Tables):
    lay = mosaic_layout(_mosaic_cells(t), {"x0": 0.0, "y1": 0.0})
    return lay.select(*big("mr", "mc"), "cell")


@query("A8 E28", f"""WITH x AS (SELECT cell, ord, col, row, {ROLE_SQL} AS role FROM {CELLS}),
 b AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM x WHERE role = 'aoi')
 SELECT CAST(row - r0 AS BIGINT) AS mr, CAST(col - c0 AS BIGINT) AS mc, count(*) AS n, CAST(sum(p.a) AS BIGINT) AS total,
  CAST(min((row - r0) * 256 + p.r) AS BIGINT) AS top FROM x, b, {STACK_PX} p
 WHERE p.cell = x.cell AND row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1 GROUP BY 1, 2""")
def mosaic_table(t: Tables):
    _, px = _stack_inputs(t)
    path = fresh_path(t.spark, "mosaic")
    grid = {"x0": 0.0, "y1": 0.0}
    write_mosaic(px, _mosaic_cells(t), grid, path)
    schema = place_cells(px, mosaic_layout(_mosaic_cells(t), grid)).schema
    return (t.spark.read.schema(schema).parquet(path).groupBy("mr", "mc")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("annual")[0]).alias("total"), F.min("gr").alias("top"))
            .select(*big("mr", "mc", "n", "total", "top")))


METRICS_SQL = f"""SELECT model, count(pred) AS n, sqrt(avg((pred - ref) * (pred - ref))) AS rmse, avg(pred - ref) AS bias,
 covar_pop(pred, ref) ** 2 / (var_pop(pred) * var_pop(ref)) AS r2 FROM {PAIRS} WHERE pred IS NOT NULL GROUP BY model"""


def _metrics(t: Tables):
    acc = paired_accuracy(t.pairs, ["model"])
    place = F.when(F.col("model") == "A", "als").when(F.col("model") == "N", "gedi_val").otherwise("study_area")
    out = acc.withColumn("section", place).withColumn("layer", F.col("model")).withColumn(
        "note", F.lit("pairs")).withColumn("mean", F.lit(float("nan")))
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast("double").alias(c) for c in METRIC_COLUMNS])


@query("A9", f"""SELECT CASE model WHEN 'A' THEN 'als' WHEN 'N' THEN 'gedi_val' ELSE 'study_area' END AS section,
 model AS layer, CAST(n AS VARCHAR) AS n, printf('%.4f', rmse) AS rmse, printf('%.4f', bias) AS bias,
 printf('%.4f', r2) AS r2, CAST(NULL AS VARCHAR) AS mean, CAST(NULL AS VARCHAR) AS p10, CAST(NULL AS VARCHAR) AS p50,
 CAST(NULL AS VARCHAR) AS p90, 'pairs' AS note FROM ({METRICS_SQL})""")
def metrics_csv(t: Tables):
    path = fresh_path(t.spark, "metrics")
    write_metrics_csv(_metrics(t), path)
    schema = ", ".join(f"{c} string" for c in METRIC_COLUMNS)
    return t.spark.read.schema(schema).option("header", True).csv(path)


@query("A10 X16", f"SELECT model AS layer, n, {R('rmse')} AS rmse, CAST(NULL AS DOUBLE) AS mean FROM ({METRICS_SQL})")
def summary_document(t: Tables):
    docs = summary_json(_metrics(t))
    back = F.from_json("summary", "layer string, n bigint, rmse double, mean double")
    return docs.select(back.alias("s")).select("s.layer", "s.n", rnd(F.col("s.rmse")).alias("rmse"), "s.mean")


@query("A11", f"""SELECT CAST(floor(r / 16) * 16 AS BIGINT) AS row, CAST(floor(c / 16) * 16 AS BIGINT) AS col,
 count(*) AS n, floor(c / 16) * 160 + 1000.0 AS x, 2000.0 - floor(r / 16) * 160 AS y
 FROM {RASTER} WHERE class > 25 GROUP BY ALL HAVING count(*) >= 100""")
def tile_index(t: Tables):
    labels = t.raster.withColumn("label", F.when(F.col("class") > 25, F.col("v")))
    kept = kept_chips(labels, 16, 100)
    return kept.select(*big("row", "col", "n"), (F.lit(1000.0) + F.col("col") * 10).alias("x"),
                       (F.lit(2000.0) - F.col("row") * 10).alias("y"))


def _height(t: Tables) -> int:
    return int(t.raster.agg(F.max("r")).first()[0]) + 1


PAD_SQL = f"""WITH h AS (SELECT CAST(max(r) + 1 AS BIGINT) AS h FROM {RASTER}),
 d AS (SELECT h, CAST(ceil(h / 64) * 64 AS BIGINT) AS th, (ceil(h / 64) * 64 - h < h AND 14 < 50) AS refl FROM h),
 rows AS (SELECT h, refl, unnest(range(0, th)) AS r FROM d), cols AS (SELECT unnest(range(0, 64)) AS c),
 src AS (SELECT r, c, h, CASE WHEN refl THEN CASE WHEN r < h THEN r ELSE 2 * (h - 1) - r END
   ELSE CASE WHEN r % (2 * h) < h THEN r % (2 * h) ELSE 2 * h - 1 - r % (2 * h) END END AS sr,
  CASE WHEN refl THEN CASE WHEN c < 50 THEN c ELSE 98 - c END ELSE CASE WHEN c < 50 THEN c ELSE 99 - c END END AS sc
  FROM rows, cols)
 SELECT s.r, s.c, p.v, CASE WHEN s.r < h AND s.c < 50 THEN p.class END AS label FROM src s
 JOIN {RASTER} p ON p.r = s.sr AND p.c = s.sc"""


@query("A12 U5 A11", PAD_SQL)
def padded_raster(t: Tables):
    px = t.raster.withColumn("label", F.col("class"))
    return pad_tiles(px, _height(t), 50, 64, missing="label").select(*big("r", "c"), "v", "label")


@query("A11", f"""SELECT CAST(floor(r / 64) AS BIGINT) AS cr, CAST(floor(c / 64) AS BIGINT) AS cc, count(*) AS n, {R('sum(v * (r % 64 + 1) * (c % 64 + 2))', 2)} AS total
 FROM ({PAD_SQL}) GROUP BY ALL""")
def tile_chips(t: Tables):
    px = chips_of(pad_tiles(t.raster, _height(t), 50, 64), 64)
    return px.groupBy("cr", "cc").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum(
        F.col("v") * (F.col("pr") + 1) * (F.col("pc") + 2)), 2).alias("total")).select(*big("cr", "cc"), "n", "total")


@query("A11 A12", f"""WITH pad AS MATERIALIZED ({PAD_SQL}),
 lab AS (SELECT floor(r / 16) AS cr, floor(c / 16) AS cc, count(*) AS n FROM {RASTER} WHERE class > 25 GROUP BY ALL HAVING count(*) >= 40),
 num AS (SELECT *, row_number() OVER (ORDER BY cr, cc) - 1 AS chip FROM lab)
 SELECT CAST(chip AS BIGINT) AS chip, 1000.0::DOUBLE + cc * 160 AS x, 2000.0::DOUBLE - cr * 160 AS y, any_value(num.n) AS n, count(*) AS pixels,
  sum(CASE WHEN label > 25 THEN 1 ELSE 0 END)::BIGINT AS labelled, {R('sum(v * (r % 16 + 1) * (c % 16 + 2))', 2)} AS total
 FROM pad JOIN num ON floor(r / 16) = cr AND floor(c / 16) = cc WHERE r < (SELECT ceil(max(r + 1) / 16) * 16 FROM {RASTER}) GROUP BY chip, cc, cr""")
def labelled_tiles(t: Tables):
    px = t.raster.withColumn("label", F.when(F.col("class") > 25, F.col("class")))
    pixels, index = tile_rasters(px, _height(t), 50, 1000.0, 2000.0, 10.0, 16, 40)
    sums = pixels.groupBy("chip").agg(F.count(F.lit(1)).alias("pixels"), F.count("label").alias("labelled"),
                                      rnd(F.sum(F.col("v") * (F.col("pr") + 1) * (F.col("pc") + 2)), 2).alias("total"))
    return index.join(sums, "chip").select(*big("chip"), "x", "y", "n", "pixels", "labelled", "total")


@query("A13 E32 U1", """WITH cache AS (SELECT o_custkey AS cell, arg_max(o_totalprice / 1000000, o_orderkey) AS water FROM orders GROUP BY o_custkey)
 SELECT cell, water FROM cache UNION ALL SELECT c_custkey * 2, 0.5 FROM customer WHERE c_custkey * 2 NOT IN (SELECT cell FROM cache)""")
def landcover_cache(t: Tables):
    cache = t.read("orders").select(F.col("o_custkey").alias("cell"), (F.col("o_totalprice") / 1000000).alias("water"), F.lit(0.0).alias("built"),
                                    F.lit(0.0).alias("tree"), F.col("o_orderkey").alias("ord"))
    cells = t.read("customer").select((F.col("c_custkey") * 2).alias("cell"))       # half of them are not in the cache
    lookup = cells.select("cell", F.lit(0.5).alias("water"), F.lit(0.0).alias("built"), F.lit(0.0).alias("tree"))
    return upsert_landcover(cache, lookup, cells).select("cell", "water")


@query("A14 B20", f"""SELECT cell, CASE WHEN col < 3 THEN 'aoi' ELSE 'ring' END AS role,
 CASE WHEN col < 3 THEN 'aoi' WHEN water < 0.5 THEN 'ring' ELSE 'dropped (water)' END AS category,
 CAST(col * 100 AS BIGINT) AS dist_m, {R('water', 3)} AS water, 5 AS points, true AS closed, true AS near FROM {CELLS}""")
def cell_features(t: Tables):
    cells = t.cells.select("cell", "x0", "y1", (F.col("x0") + 584670).alias("x"), (F.col("y1") + 550110).alias("y"),
                           F.when(F.col("col") < 3, "aoi").otherwise("ring").alias("role"),
                           (F.col("col") * 100).alias("dist_m"), "water", ((F.col("col") < 3) | (F.col("water") < 0.5)).alias("use"))
    feats = cells_to_geojson(cells.withColumn("x0", F.col("x")).withColumn("y1", F.col("y")), 32650)
    f = F.from_json("feature", "geometry struct<coordinates:array<array<array<double>>>>, properties struct<cell:string,"
                    "role:string,category:string,dist_m:bigint,water:double>")
    ring = F.col("f.geometry.coordinates")[0]
    # the plan's rows go on for as long as the table: the place of a corner is its projection, not a fixed one
    at = F.substring("f.properties.cell", 5, 20).cast("bigint")
    east, north = utm_forward(ring[0][0], ring[0][1], F.lit(32650))
    x, y = at % 10 * 2560.0 + 584670, F.floor(at / 10) * -2560.0 + 550110
    return feats.select(f.alias("f")).select(
        "f.properties.*", F.size(ring).alias("points"), (ring[0] == ring[4]).alias("closed"),
        ((F.abs(east - x) < 0.1) & (F.abs(north - y) < 0.1)).alias("near")).withColumn(
        "water", rnd(F.col("water"), 3))


@query("A15 B14", f"""SELECT l.r, l.c, CASE WHEN m.r IS NOT NULL THEN {R('l.v')} END AS v, 'net' AS model
 FROM (SELECT l_orderkey % 1024 AS r, l_partkey % 512 AS c, avg(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R'
 GROUP BY ALL) l LEFT JOIN {MASK} m ON l.r = m.r AND l.c = m.c""")
def masked_map(t: Tables):
    pred = t.layer.where("layer = 'R'")
    return materialise_map(pred, t.mask, "net").withColumn("v", rnd(F.col("v")))


@query("A16", """SELECT r_name AS region, n_name AS country, CAST(2000 + n_nationkey AS INT) AS year, 2 AS n_models, CAST(n_nationkey * 0.5 AS DOUBLE) AS west
 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey NOT IN (2, 9, 14)""")
def region_table(t: Tables):
    n = t.read("nation").join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    props = F.struct(F.col("r_name").alias("region"), F.col("n_name").alias("country"),
                     (F.col("n_nationkey") + 2000).alias("year"), F.array(F.lit("a"), F.lit("b")).alias("models"),
                     F.array(F.col("n_nationkey") * 0.5, F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("default_box"))
    geom = F.struct(F.lit("Polygon").alias("type"), F.array().cast("array<array<array<double>>>").alias("coordinates"))
    feats = n.where(~F.col("n_nationkey").isin(2, 9, 14)).select(
        F.col("n_regionkey").alias("doc_id"), F.struct(F.lit("Feature").alias("type"), props.alias("properties"),
                                                       geom.alias("geometry")).alias("f"))
    # a document per region of the 25-row table
    docs = feats.groupBy("doc_id").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"),
                                                          F.collect_list("f").alias("features"))).alias("doc"))
    return scan_regions(docs).select("region", "country", "year", F.size("models").alias("n_models"),
                                     F.col("default_box")[0].alias("west"))


@query("X10 X1", """SELECT c_custkey AS id, CAST(CASE WHEN (c_custkey * 11) % 160 - 80 >= 0 THEN 32600 ELSE 32700 END
 + least(greatest(floor(((c_custkey * 7) % 380 - 190 + 180.0) / 6.0) + 1, 1), 60) AS INT) AS epsg,
 'x' || CAST(CAST(round_even(c_acctbal / 2, 0) AS BIGINT) AS VARCHAR) || 'y' || CAST(CAST(round_even(c_acctbal * 3, 0) AS BIGINT) AS VARCHAR) AS cell
 FROM customer""")
def zones_and_names(t: Tables):
    from ..functions.geodesy import cell_name
    k = F.col("c_custkey")
    return t.read("customer").select(
        k.alias("id"), utm_epsg(((k * 7) % 380 - 190).cast("double"), ((k * 11) % 160 - 80).cast("double")).alias("epsg"),
        cell_name(F.col("c_acctbal") / 2, F.col("c_acctbal") * 3).alias("cell"))


