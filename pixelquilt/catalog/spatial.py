"""Polygon masks, cell overlap and distance, footprints, region shares."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import spatial as S
from ..sources.geojson import scan_polygons
from .base import EDGES, R, RASTER, Tables, big, query, rnd

INSIDE_PARTS = f"""(SELECT e.id, e.part, p.r, p.c, p.v FROM {RASTER} p, {EDGES} e
 WHERE least(e.y1, e.y2) <= -(p.r + 0.5) * 10 AND -(p.r + 0.5) * 10 < greatest(e.y1, e.y2)
  AND e.x1 + (-(p.r + 0.5) * 10 - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) <= (p.c + 0.5) * 10
 GROUP BY ALL HAVING count(*) % 2 = 1)"""
INSIDE = f"(SELECT DISTINCT id, r, c, v FROM {INSIDE_PARTS})"


def area_edges(t: Tables) -> DataFrame:
    return scan_polygons(t.area_docs)


@query("C2 A5", f"SELECT id, count(*) AS n, {R('sum(v)', 4)} AS total, CAST(min(r) AS BIGINT) AS top FROM {INSIDE} GROUP BY id")
def pixels_in_polygons(t: Tables):
    inside = S.pixels_in_polygon(t.raster, area_edges(t), 0.0, 0.0)
    return inside.groupBy("id").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("v"), 4).alias("total"), F.min("r").alias("top"))


@query("C2 B14", f"SELECT r, c, v, r IN (SELECT r FROM {INSIDE} i WHERE i.r = p.r AND i.c = p.c) AS inside FROM {RASTER} p")
def area_mask(t: Tables):
    any_part = S.span_pixels(S.polygon_spans(area_edges(t), 0.0, 0.0), keys=[]).withColumn("_in", F.lit(True))
    return t.raster.join(any_part, ["r", "c"], "left").select("r", "c", "v", F.coalesce("_in", F.lit(False)).alias("inside"))


@query("A17 B14", f"SELECT r, c, v, class FROM {RASTER} p SEMI JOIN {INSIDE} i ON i.r = p.r AND i.c = p.c")
def clipped_layer(t: Tables):
    """A layer restricted to the study areas by the runs of their rows."""
    return S.clip(t.raster, area_edges(t), 0.0, 0.0)


@query("C19 I1 E32", f"SELECT r, count(DISTINCT c) AS n FROM {INSIDE} GROUP BY r")
def dissolved_area(t: Tables):
    rows = t.raster.agg(F.max("r").alias("r")).scalar()
    px = S.span_pixels(S.polygon_spans(area_edges(t), 0.0, 0.0), width=50, keys=[]).where((F.col("r") >= 0) & (F.col("r") <= rows))
    return px.groupBy("r").agg(F.count(F.lit(1)).alias("n"))


@query("E29 X10", f"""SELECT id, {R('sum(a) / 2', 3)} AS area, {R('sum(cx) / sum(a) / 3')} AS x, {R('sum(cy) / sum(a) / 3')} AS y FROM (
 SELECT id, part, abs(sum(x1 * y2 - x2 * y1)) AS a, sum((x1 + x2) * (x1 * y2 - x2 * y1)) * sign(sum(x1 * y2 - x2 * y1)) AS cx,
 sum((y1 + y2) * (x1 * y2 - x2 * y1)) * sign(sum(x1 * y2 - x2 * y1)) AS cy FROM {EDGES} GROUP BY id, part) GROUP BY id""")
def polygon_areas(t: Tables):
    edges = area_edges(t)
    return (S.polygon_area(edges).join(S.polygon_centroid(edges), "id")
            .select("id", rnd(F.col("area"), 3).alias("area"), rnd(F.col("x")).alias("x"), rnd(F.col("y")).alias("y")))


_Q = lambda s: f"({1 - 6.69437999014131699614e-3!r}::DOUBLE * ({s} / (1 - 6.69437999014131699614e-3::DOUBLE * {s} * {s}) + ln((1 + 0.0818191908426214957::DOUBLE * {s}) / (1 - 0.0818191908426214957::DOUBLE * {s})) / 0.1636383816852429914::DOUBLE))"
_HALF = lambda lat: f"tan(asin(least(1, greatest(-1, {_Q(f'sin(radians({lat}))')} / {_Q('1.0::DOUBLE')}))) / 2)"


@query("E29", f"""SELECT id, {R('sum(a)', 3)} AS km2 FROM (SELECT id, part, abs(sum(2 * atan(tan(radians(lon2 - lon1) / 2) * (t1 + t2) / (1 + t1 * t2)))) / 2
  * {_Q('1.0::DOUBLE')} * 40680631.59076900::DOUBLE AS a FROM (SELECT id, part, x1 / 10000 AS lon1, x2 / 10000 AS lon2,
  {_HALF('y1 / 10000')} AS t1, {_HALF('y2 / 10000')} AS t2 FROM {EDGES}) GROUP BY id, part) GROUP BY id""")
def geodesic_areas(t: Tables):
    at = area_edges(t)
    degrees = at.withColumns({c: F.col(c) / 10000 for c in ("x1", "y1", "x2", "y2")})
    return S.geodesic_area(degrees).select("id", rnd(F.col("area") / 1e6, 3).alias("km2"))


# study area: a pentagon with one corner per region
CORNERS = [(5000, -3000), (16000, -2500), (21000, -12000), (9000, -19000), (2500, -11000)]
_XS = "CASE r_regionkey " + " ".join(f"WHEN {k} THEN {x}.0" for k, (x, _) in enumerate(CORNERS)) + " END"
_YS = "CASE r_regionkey " + " ".join(f"WHEN {k} THEN {y}.0" for k, (_, y) in enumerate(CORNERS)) + " END"
STUDY = f"""(SELECT CAST(a.x AS DOUBLE) AS x1, CAST(a.y AS DOUBLE) AS y1, CAST(b.x AS DOUBLE) AS x2, CAST(b.y AS DOUBLE) AS y2
 FROM (SELECT r_regionkey AS k, {_XS} AS x, {_YS} AS y FROM region) a JOIN (SELECT r_regionkey AS k, {_XS} AS x, {_YS} AS y FROM region) b
 ON b.k = (a.k + 1) % 5)"""


def study_edges(t: Tables) -> DataFrame:
    v = t.read("region").selectExpr("r_regionkey AS k", f"CAST({_XS} AS DOUBLE) AS x", f"CAST({_YS} AS DOUBLE) AS y")
    nxt = v.select(((F.col("k") + 4) % 5).alias("k"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    zero = F.col("k") * 0
    return v.join(nxt, "k").select(zero.alias("id"), zero.cast("string").alias("part"), zero.alias("ring"),
                                   F.col("k").alias("seq"), F.lit(False).alias("hole"), F.col("x").alias("x1"),
                                   F.col("y").alias("y1"), "x2", "y2")


GX, GY, M = 2500.0, -2500.0, 2560.0
_G = lambda u: f"(CASE WHEN {u} <= 0 THEN 0 WHEN {u} < {M} THEN {u} * {u} / 2 ELSE {M} * {u} - {M} * {M} / 2 END)"
_PS = lambda px, py: (f"sqrt(pow({px} - (x1 + least(greatest((({px} - x1) * (x2 - x1) + ({py} - y1) * (y2 - y1)) / l2, 0), 1) * (x2 - x1)), 2)"  # noqa: E731
                      f" + pow({py} - (y1 + least(greatest((({px} - x1) * (x2 - x1) + ({py} - y1) * (y2 - y1)) / l2, 0), 1) * (y2 - y1)), 2))")
_PB = lambda px, py: f"sqrt(pow(greatest(bx0 - {px}, {px} - bx1, 0), 2) + pow(greatest(by0 - {py}, {py} - by1, 0), 2))"


def area_cells_sql(reach: float) -> str:
    """Brute force: every candidate cell against every edge."""
    n = int(reach // M) + 2
    return f"""(WITH b AS (SELECT col, row, {GX} + col * {M} AS bx0, {GX} + (col + 1) * {M} AS bx1, {GY} - (row + 1) * {M} AS by0, {GY} - row * {M} AS by1
   FROM range({-n}, {8 + n}) a(col), range({-n}, {7 + n}) d(row)),
 p AS (SELECT *, pow(x2 - x1, 2) + pow(y2 - y1, 2) AS l2, (y2 - y1) / (x2 - x1) AS s FROM b, {STUDY}),
 q AS (SELECT *, least(greatest(x1, bx0), bx1) AS xa, least(greatest(x2, bx0), bx1) AS xb,
   greatest(least((bx0 - x1) / (x2 - x1), (bx1 - x1) / (x2 - x1)), least((by0 - y1) / (y2 - y1), (by1 - y1) / (y2 - y1)), 0) AS ta,
   least(greatest((bx0 - x1) / (x2 - x1), (bx1 - x1) / (x2 - x1)), greatest((by0 - y1) / (y2 - y1), (by1 - y1) / (y2 - y1)), 1) AS tb FROM p),
 u AS (SELECT *, y1 + (xa - x1) * s - by0 AS ua, y1 + (xb - x1) * s - by0 AS ub FROM q),
 r AS (SELECT col, row, bx0, by1, abs(sum(({_G('ub')} - {_G('ua')}) / s)) AS area, bool_or(ta <= tb) AS hit,
   sum(CASE WHEN least(y1, y2) <= (by0 + by1) / 2 AND (by0 + by1) / 2 < greatest(y1, y2) AND x1 + ((by0 + by1) / 2 - y1) / s <= (bx0 + bx1) / 2 THEN 1 ELSE 0 END) % 2 = 1 AS centre,
   min(least({', '.join([_PB('x1', 'y1'), _PB('x2', 'y2')] + [_PS(a, c) for a in ('bx0', 'bx1') for c in ('by0', 'by1')])})) AS gap FROM u GROUP BY ALL)
 SELECT 'x' || CAST(CAST(round_even(bx0, 0) AS BIGINT) AS VARCHAR) || 'y' || CAST(CAST(round_even(by1, 0) AS BIGINT) AS VARCHAR) AS cell,
  bx0 AS x0, by1 AS y1, col, row, area, CASE WHEN hit OR centre THEN 0 ELSE gap END AS dist FROM r
 WHERE round_even(CASE WHEN hit OR centre THEN 0 ELSE gap END, 0) <= {reach})"""


@query("C1 U4 X1", f"SELECT cell, col, row, {R('area', 2)} AS area, {R('dist', 3)} AS dist FROM {area_cells_sql(6000)}")
def cells_in_area(t: Tables):
    out = S.cells_in_area(study_edges(t), GX, GY, 6000)
    return out.select("cell", *big("col", "row"), rnd(F.col("area"), 2).alias("area"), rnd(F.col("dist"), 3).alias("dist"))


@query("X11 D1", f"""SELECT floor(min(least(x1, x2)) / 10 + 0.01::DOUBLE) * 10 AS x0, ceil(max(greatest(y1, y2)) / 10 - 0.01::DOUBLE) * 10 AS y1 FROM {STUDY}""")
def study_grid(t: Tables):
    return S.study_grid(study_edges(t))


SCENE_BOX = """(SELECT c_custkey AS id, ((c_custkey * 7) % 300 - 150) / 1.0 AS minx, ((c_custkey * 3) % 140 - 70) / 1.0 AS miny,
 ((c_custkey * 7) % 300 - 150) + 2.5 AS maxx, ((c_custkey * 3) % 140 - 70) + 1.75 AS maxy FROM customer)"""
CELL_BOX = """(SELECT s_suppkey AS cell, ((s_suppkey * 37) % 3000 - 1500) / 10.0 + 0.01 AS minx, ((s_suppkey * 53) % 1400 - 700) / 10.0 + 0.01 AS miny,
 ((s_suppkey * 37) % 3000 - 1500) / 10.0 + 0.04 AS maxx, ((s_suppkey * 53) % 1400 - 700) / 10.0 + 0.04 AS maxy FROM supplier)"""


@query("C3", f"""SELECT s.id, c.cell FROM {SCENE_BOX} s JOIN {CELL_BOX} c ON s.minx <= c.maxx + 0.03 AND c.minx - 0.03 <= s.maxx
 AND s.miny <= c.maxy + 0.03 AND c.miny - 0.03 <= s.maxy""")
def scene_footprints(t: Tables):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    x, y = ((k * 7) % 300 - 150) / 1.0, ((k * 3) % 140 - 70) / 1.0
    scenes = t.read("customer").select(k.alias("id"), x.alias("minx"), y.alias("miny"), (x + 2.5).alias("maxx"), (y + 1.75).alias("maxy"))
    u, v = ((s * 37) % 3000 - 1500) / 10.0, ((s * 53) % 1400 - 700) / 10.0
    cells = t.read("supplier").select(s.alias("cell"), (u + 0.01).alias("minx"), (v + 0.01).alias("miny"),
                                      (u + 0.04).alias("maxx"), (v + 0.04).alias("maxy"))
    return S.footprint_pairs(scenes, cells)


@query("C15", f"""SELECT {R('avg(CASE WHEN i.r IS NOT NULL THEN 1.0 ELSE 0 END)')} AS inside,
 CASE WHEN count(i.r) = 0 THEN 'outside' WHEN count(i.r) < 0.999 * count(*) THEN 'partial' ELSE 'inside' END AS note FROM {RASTER} p
 LEFT JOIN (SELECT DISTINCT r, c FROM {INSIDE} WHERE id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)) i ON i.r = p.r AND i.c = p.c WHERE p.class > 10""")
def region_shares(t: Tables):
    region = S.span_pixels(S.polygon_spans(scan_polygons(t.area_docs.where("balance > 5000")), 0.0, 0.0))
    return S.region_share(t.raster.where("class > 10"), region).select(rnd(F.col("inside")).alias("inside"), "note")
