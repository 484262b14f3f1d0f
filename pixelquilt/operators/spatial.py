"""Polygons on grids: pixel masks, cell overlap and distance, footprints. All joins are equality joins on grid keys."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geodesy import area_to_equator, cell_name, snap_origin_x, snap_origin_y
from ..scale import spread
from ..schema import CELL_M, RES


def _long(c: Column) -> Column:
    return c.cast("long")


def polygon_spans(edges: DataFrame, x0: float, y1: float, res: float = RES, key: str = "id") -> DataFrame:
    """Pixel runs (key, part, r, c0, c1) whose centres lie inside a polygon (even-odd rule, half-open edges).

    Every edge is sent to the raster rows whose centre line it crosses; a crossing toggles all centres from its
    column on. Toggles are counted per (part, row, column) before they are ordered, so a row holds at most one
    entry per raster column however many edges cross it. No pixel is ever paired with an edge.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first = F.floor((y1 - high) / res - 0.5) + 1
    last = F.floor((y1 - low) / res - 0.5)
    rows = (edges.withColumn("_a", _long(first)).withColumn("_b", _long(last)).where("_a <= _b")
            .withColumn("r", F.explode(F.sequence("_a", "_b"))))
    yc = F.lit(y1) - (F.col("r") + 0.5) * res
    xc = F.col("x1") + (yc - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    toggles = (rows.withColumn("c0", _long(F.ceil((xc - x0) / res - 0.5)))
               .groupBy(key, "part", "r", "c0").agg((F.count(F.lit(1)) % 2).alias("_odd")).where("_odd = 1"))
    along = Window.partitionBy(key, "part", "r").orderBy("c0")
    return (toggles.withColumn("_k", F.row_number().over(along)).withColumn("c1", F.lead("c0").over(along) - 1)
            .where("_k % 2 = 1").select(key, "part", "r", "c0", "c1"))


def dissolve(spans: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Union of runs that overlap or touch: (keys, r, c0, c1) without a pixel in two runs. Works on the runs, of which
    a row has at most one per raster column after the first aggregation."""
    starts = spans.groupBy(*keys, "r", "c0").agg(F.max("c1").alias("c1"))
    along = Window.partitionBy(*keys, "r").orderBy("c0")
    reach = F.max("c1").over(along.rowsBetween(Window.unboundedPreceding, -1))
    first = F.when(F.col("c0") <= reach + 1, 0).otherwise(1)
    return (starts.withColumn("_first", first)
            .withColumn("_run", F.sum("_first").over(along.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(*keys, "r", "_run").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("_run"))


def span_pixels(spans: DataFrame, height: int | None = None, width: int | None = None,
                keys: list[str] = ("id",)) -> DataFrame:
    """Pixels of the runs, clipped to the raster; a pixel of several parts of one polygon comes once. keys=[] gives the
    pixels of the union of all polygons."""
    out = dissolve(spans, list(keys))
    if height is not None:
        out = out.where(F.col("r").between(0, height - 1))
    if width is not None:
        out = (out.withColumn("c0", F.greatest("c0", F.lit(0))).withColumn("c1", F.least("c1", F.lit(width - 1)))
               .where("c0 <= c1"))
    return out.select(*keys, "r", F.explode(F.sequence("c0", "c1")).alias("c"))


def pixels_in_polygon(px: DataFrame, edges: DataFrame, x0: float, y1: float, res: float = RES,
                      key: str = "id") -> DataFrame:
    """Pixels (r, c) of a table inside each polygon: equality join of the pixels with the polygons' pixels."""
    return px.join(span_pixels(polygon_spans(edges, x0, y1, res, key), keys=[key]), ["r", "c"])


def clip_to_runs(layer: DataFrame, runs: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Layer pixels (keys, r, c, ...) inside runs (keys, r, c0, c1) that do not overlap in a row: an as-of look at the run
    that began last in the row. No pixel of the mask is made; the layer is shuffled once, by its rows."""
    marks = runs.select(*keys, F.col("r"), F.col("c0").alias("c"), F.col("c1").alias("_end"), F.lit(True).alias("_run"))
    both = layer.withColumn("_run", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    # a run stands before the pixel it begins with
    upto = Window.partitionBy(*keys, "r").orderBy("c", F.col("_run").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_end", F.last("_end", True).over(upto)).where(~F.col("_run") & (F.col("_end") >= F.col("c"))).drop("_end", "_run")


def clip(layer: DataFrame, edges: DataFrame, x0: float, y1: float, res: float = RES) -> DataFrame:
    """Pixels (r, c, ...) of a layer on the grid of (x0, y1) whose centres lie in any of the polygons."""
    return clip_to_runs(layer, dissolve(polygon_spans(edges, x0, y1, res)))


def covers_pixels(edges: DataFrame, x0: float, y1: float, need: int, res: float = RES) -> bool:
    """Does the area contain at least `need` pixel centres; stops counting there."""
    return span_pixels(polygon_spans(edges, x0, y1, res), keys=[]).limit(need).count() >= need


def study_grid(edges: DataFrame) -> DataFrame:
    """One row (x0, y1): upper-left corner of the bounding box, snapped to the 10 m grid."""
    return edges.agg(F.least(F.min("x1"), F.min("x2")).alias("minx"),
                     F.greatest(F.max("y1"), F.max("y2")).alias("maxy")).select(
        snap_origin_x(F.col("minx")).cast("double").alias("x0"), snap_origin_y(F.col("maxy")).cast("double").alias("y1"))


def ring_areas(edges: DataFrame, key: str = "id") -> DataFrame:
    """Signed shoelace area of every ring."""
    return edges.groupBy(key, "part", "ring", "hole").agg(
        (F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("area"))


def polygon_area(edges: DataFrame, key: str = "id") -> DataFrame:
    """Planar area per polygon, holes subtracted whatever their orientation."""
    return ring_areas(edges, key).groupBy(key).agg(
        F.sum(F.when(F.col("hole"), -F.abs("area")).otherwise(F.abs("area"))).alias("area"))


def geodesic_area(edges: DataFrame, key: str = "id") -> DataFrame:
    """Area in square metres on the ellipsoid of polygons in degrees (x longitude, y latitude), holes subtracted."""
    rings = edges.groupBy(key, "part", "ring", "hole").agg(F.sum(area_to_equator(*map(F.col, ("x1", "y1", "x2", "y2")))).alias("area"))
    return rings.groupBy(key).agg(F.sum(F.when(F.col("hole"), -F.abs("area")).otherwise(F.abs("area"))).alias("area"))


def polygon_centroid(edges: DataFrame, key: str = "id") -> DataFrame:
    """(key, x, y): area-weighted centroid from edge sums."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    sums = edges.groupBy(key, "part", "ring", "hole").agg(
        F.sum(cross).alias("a"), F.sum((F.col("x1") + F.col("x2")) * cross).alias("sx"),
        F.sum((F.col("y1") + F.col("y2")) * cross).alias("sy"))
    sign = F.when(F.col("hole"), -F.signum("a")).otherwise(F.signum("a"))
    return sums.groupBy(key).agg((F.sum(sign * F.col("sx")) / F.sum(sign * F.col("a")) / 3).alias("x"),
                                 (F.sum(sign * F.col("sy")) / F.sum(sign * F.col("a")) / 3).alias("y"))


def _pieces(edges: DataFrame, x0: float, y1: float, m: float) -> DataFrame:
    """Edges cut at the cell borders: (part, col, row, sign, xa, ya, xb, yb), each piece in exactly one cell."""
    signs = ring_areas(edges).select("id", "part", "ring", F.when(
        F.col("hole"), -F.signum("area")).otherwise(F.signum("area")).alias("sign"))
    e = edges.join(signs, ["id", "part", "ring"])
    lo, hi = F.least("x1", "x2"), F.greatest("x1", "x2")
    ca = _long(F.floor((lo - x0) / m))
    cb = F.greatest(ca, _long(F.ceil((hi - x0) / m)) - 1)
    cols = e.withColumn("col", F.explode(F.sequence(ca, cb)))
    left, right = F.lit(x0) + F.col("col") * m, F.lit(x0) + (F.col("col") + 1) * m
    dx = F.col("x2") - F.col("x1")

    def at_x(x: Column) -> Column:
        return F.when(x == F.col("x1"), F.col("y1")).when(x == F.col("x2"), F.col("y2")).otherwise(
            F.col("y1") + (x - F.col("x1")) * (F.col("y2") - F.col("y1")) / dx)
    xa, xb = F.least(F.greatest("x1", left), right), F.least(F.greatest("x2", left), right)
    cols = (cols.withColumn("xa", F.when(dx == 0, F.col("x1")).otherwise(xa))
            .withColumn("xb", F.when(dx == 0, F.col("x2")).otherwise(xb)))
    cols = (cols.withColumn("ya", F.when(dx == 0, F.col("y1")).otherwise(at_x(F.col("xa"))))
            .withColumn("yb", F.when(dx == 0, F.col("y2")).otherwise(at_x(F.col("xb")))))
    top, bottom = F.greatest("ya", "yb"), F.least("ya", "yb")
    ra = _long(F.floor((F.lit(y1) - top) / m))
    rb = F.greatest(ra, _long(F.ceil((F.lit(y1) - bottom) / m)) - 1)
    cells = cols.select("part", "col", "sign", "xa", "ya", "xb", "yb", F.explode(F.sequence(ra, rb)).alias("row"))
    up, down = F.lit(y1) - F.col("row") * m, F.lit(y1) - (F.col("row") + 1) * m
    dy = F.col("yb") - F.col("ya")

    def at_y(y: Column) -> Column:
        return F.when(y == F.col("ya"), F.col("xa")).when(y == F.col("yb"), F.col("xb")).otherwise(
            F.col("xa") + (y - F.col("ya")) * (F.col("xb") - F.col("xa")) / dy)
    ya, yb = F.least(F.greatest("ya", down), up), F.least(F.greatest("yb", down), up)
    return cells.select("part", "col", "row", "sign",
                        F.when(dy == 0, F.col("xa")).otherwise(at_y(ya)).alias("xa"),
                        F.when(dy == 0, F.col("ya")).otherwise(ya).alias("ya"),
                        F.when(dy == 0, F.col("xb")).otherwise(at_y(yb)).alias("xb"),
                        F.when(dy == 0, F.col("yb")).otherwise(yb).alias("yb"))


def _point_segment(px: Column, py: Column) -> Column:
    dx, dy = F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya")
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(((px - F.col("xa")) * dx + (py - F.col("ya")) * dy)
                                                  / F.when(length == 0, F.lit(1.0)).otherwise(length))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(px - (F.col("xa") + t * dx), py - (F.col("ya") + t * dy))


def _point_box(px: Column, py: Column, bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    gx = F.greatest(bx0 - px, px - bx1, F.lit(0.0))
    gy = F.greatest(by0 - py, py - by1, F.lit(0.0))
    return F.hypot(gx, gy)


def cells_in_area(edges: DataFrame, x0: float, y1: float, reach: float, m: float = CELL_M) -> DataFrame:
    """Cells (cell, x0, y1, col, row, area, dist) within `reach` metres of a study area.

    area is the overlap in m2 (parts of the area must not overlap each other), dist the box-polygon distance (0 when
    touching). Edges are cut at cell borders. The overlap is the signed area under the pieces of the cell plus the
    full cell height times the net width of the pieces above it: one running sum per cell column. The distance is
    found by filter and refine: cells near a boundary cell first take the smallest upper bound, then only boundary
    cells that can beat it contribute their pieces. Work grows with the boundary, not with cells x edges.
    """
    pieces = _pieces(edges, x0, y1, m)
    height = F.lit(y1) - (F.col("row") + 1) * m
    under = ((F.col("ya") + F.col("yb")) / 2 - height) * (F.col("xb") - F.col("xa"))
    hit = pieces.groupBy("col", "row").agg(F.sum(F.col("sign") * under).alias("under"),
                                           F.sum(F.col("sign") * (F.col("xb") - F.col("xa"))).alias("width"))
    column = Window.partitionBy("col").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows_of = hit.groupBy("col").agg(F.min("row").alias("_a"), F.max("row").alias("_b"))
    swept = (rows_of.select("col", F.explode(F.sequence("_a", "_b")).alias("row")).join(hit, ["col", "row"], "left")
             .withColumn("_above", F.coalesce(F.sum("width").over(column), F.lit(0.0)))
             .select("col", "row", F.col("under").isNotNull().alias("edge"),
                     F.abs(F.coalesce("under", F.lit(0.0)) + F.col("_above") * m).alias("area")))
    reach = float(reach) + 0.5                       # distances count rounded to whole metres
    n = int(reach // m) + 2
    steps = F.sequence(F.lit(-n), F.lit(n))
    near = (spread(hit, "col", "row").select(F.col("col").alias("ec"), F.col("row").alias("er"))
            .withColumn("_dc", F.explode(steps)).withColumn("_dr", F.explode(steps))
            .select("ec", "er", (F.col("ec") + F.col("_dc")).alias("col"), (F.col("er") + F.col("_dr")).alias("row"),
                    (F.hypot(F.greatest(F.abs("_dc") - 1, F.lit(0)).cast("double"),
                             F.greatest(F.abs("_dr") - 1, F.lit(0)).cast("double")) * m).alias("lower"),
                    (F.hypot(F.abs("_dc").cast("double"), F.abs("_dr").cast("double")) * m).alias("upper"))
            .where(F.col("lower") <= reach))
    best = near.groupBy("col", "row").agg(F.min("upper").alias("_best"))
    pairs = near.join(best, ["col", "row"]).where("lower <= _best + 1e-6").select("ec", "er", "col", "row")
    bx0, by1 = F.lit(x0) + F.col("col") * m, F.lit(y1) - F.col("row") * m
    bx1, by0 = bx0 + m, by1 - m
    gap = F.least(*[_point_box(F.col(x), F.col(y), bx0, by0, bx1, by1) for x, y in (("xa", "ya"), ("xb", "yb"))],
                  *[_point_segment(px, py) for px in (bx0, bx1) for py in (by0, by1)])
    # a piece inside the cell itself has distance 0 (its end points are in the box)
    dist = (pairs.join(pieces.select(F.col("col").alias("ec"), F.col("row").alias("er"), "xa", "ya", "xb", "yb"),
                       ["ec", "er"]).groupBy("col", "row").agg(F.min(gap).alias("dist")))
    inner = swept.where(~F.col("edge") & (F.col("area") > 0)).select("col", "row", F.lit(0.0).alias("_zero"))
    every = dist.join(inner, ["col", "row"], "full_outer").join(swept, ["col", "row"], "left")
    return (every.select("col", "row", F.coalesce("area", F.lit(0.0)).alias("area"),
                         F.coalesce("_zero", "dist").alias("dist"))
            .where(F.rint("dist") <= reach - 0.5)
            .withColumn("x0", F.lit(x0) + F.col("col") * m).withColumn("y1", F.lit(y1) - F.col("row") * m)
            .withColumn("cell", cell_name(F.col("x0"), F.col("y1")))
            .select("cell", "x0", "y1", "col", "row", "area", "dist"))


def footprint_pairs(scenes: DataFrame, cells: DataFrame, slack: float = 0.03, bucket: float = 0.5) -> DataFrame:
    """(id, cell) of scene and cell boxes (minx, miny, maxx, maxy in degrees) that meet within `slack`.

    Both sides go to the lon / lat buckets they touch and meet by an equality join; a pair found in several buckets
    is kept only in the bucket of its lower-left common corner, so no de-duplication shuffle is needed.
    """
    def bucketed(df: DataFrame, key: str, pad: float) -> DataFrame:
        box = df.select(key, (F.col("minx") - pad).alias("minx"), (F.col("miny") - pad).alias("miny"),
                        (F.col("maxx") + pad).alias("maxx"), (F.col("maxy") + pad).alias("maxy"))

        def span(a: str, b: str) -> Column:
            return F.sequence(_long(F.floor(F.col(a) / bucket)), _long(F.floor(F.col(b) / bucket)))
        return (box.withColumn("bx", F.explode(span("minx", "maxx")))
                .withColumn("by", F.explode(span("miny", "maxy"))))
    s, c = bucketed(scenes, "id", 0.0).alias("s"), bucketed(cells, "cell", slack).alias("c")
    meet = ((F.col("s.bx") == F.col("c.bx")) & (F.col("s.by") == F.col("c.by"))
            & (F.col("s.minx") <= F.col("c.maxx")) & (F.col("c.minx") <= F.col("s.maxx"))
            & (F.col("s.miny") <= F.col("c.maxy")) & (F.col("c.miny") <= F.col("s.maxy")))
    corner = ((_long(F.floor(F.greatest("s.minx", "c.minx") / bucket)) == F.col("s.bx"))
              & (_long(F.floor(F.greatest("s.miny", "c.miny") / bucket)) == F.col("s.by")))
    return s.join(c, meet & corner).select("id", "cell")


def region_share(area_px: DataFrame, region_px: DataFrame) -> DataFrame:
    """One row (inside, note): share of the area's pixels inside the region, and what it means."""
    flagged = area_px.join(region_px.select("r", "c").distinct().withColumn("_in", F.lit(1.0)), ["r", "c"], "left")
    share = flagged.agg(F.avg(F.coalesce("_in", F.lit(0.0))).alias("inside"))
    note = (F.when(F.coalesce("inside", F.lit(0.0)) == 0, "outside")
            .when(F.col("inside") < 0.999, "partial")
            .otherwise("inside"))
    return share.select("inside", note.alias("note"))


__all__ = ["polygon_spans", "dissolve", "span_pixels", "pixels_in_polygon", "clip", "clip_to_runs", "covers_pixels", "study_grid", "polygon_area",
           "polygon_centroid", "cells_in_area", "footprint_pairs", "region_share"]
