"""GeoJSON documents to edge tables and back."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geodesy import utm_inverse
from ..schema import CELL_M

_RING = "array<array<array<double>>>"


def scan_polygons(docs: DataFrame, key: str = "id", doc: str = "doc") -> DataFrame:
    """Edge table (key, part, ring, seq, hole, x1, y1, x2, y2) of the polygonal parts of GeoJSON texts.

    A document is a FeatureCollection, a Feature or a bare geometry; collections are opened, points and lines
    dropped, attributes ignored, third coordinates ignored. Unknown document types are an error.
    """
    def get(col, path):
        return F.get_json_object(col, path)

    kind = get(F.col(doc), "$.type")
    known = ("FeatureCollection", "Feature", "Polygon", "MultiPolygon", "GeometryCollection", "Point",
             "MultiPoint", "LineString", "MultiLineString")
    checked = docs.withColumn("_kind", F.when(kind.isin(*known), kind).otherwise(
        F.raise_error(F.concat(F.lit("not a GeoJSON object: "), F.coalesce(kind, F.lit("no type")))).cast("string")))
    items = F.when(F.col("_kind") == "FeatureCollection",
                   F.transform(F.from_json(get(F.col(doc), "$.features"), "array<string>"),
                               lambda f: F.get_json_object(f, "$.geometry"))) \
        .when(F.col("_kind") == "Feature", F.array(get(F.col(doc), "$.geometry"))) \
        .otherwise(F.array(F.col(doc)))
    geometries = checked.select(key, F.posexplode(items).alias("_g1", "_geom")).where("_geom IS NOT NULL")
    for level in ("_g2", "_g3"):                       # collections inside collections
        opened = F.when(get(F.col("_geom"), "$.type") == "GeometryCollection",
                        F.from_json(get(F.col("_geom"), "$.geometries"), "array<string>")) \
            .otherwise(F.array("_geom"))
        geometries = geometries.select(*[c for c in geometries.columns if c != "_geom"],
                                       F.posexplode(opened).alias(level, "_geom"))
    text = get(F.col("_geom"), "$.coordinates")
    polygons = F.when(get(F.col("_geom"), "$.type") == "Polygon", F.array(F.from_json(text, _RING))) \
        .when(get(F.col("_geom"), "$.type") == "MultiPolygon", F.from_json(text, f"array<{_RING}>"))
    parts = geometries.select(key, "_g1", "_g2", "_g3", F.posexplode(polygons).alias("_g4", "_rings"))
    rings = parts.select(key, F.concat_ws(".", "_g1", "_g2", "_g3", "_g4").alias("part"),
                         F.posexplode("_rings").alias("ring", "_pts"))
    steps = F.transform(F.sequence(F.lit(1), F.size("_pts") - 1),
                        lambda i: F.struct(F.element_at("_pts", i).alias("a"), F.element_at("_pts", i + 1).alias("b")))
    return (rings.where(F.size("_pts") > 1)
            .select(key, "part", "ring", (F.col("ring") > 0).alias("hole"), F.posexplode(steps).alias("seq", "_s"))
            .select(key, "part", "ring", "seq", "hole", F.col("_s.a")[0].alias("x1"), F.col("_s.a")[1].alias("y1"),
                    F.col("_s.b")[0].alias("x2"), F.col("_s.b")[1].alias("y2")))


def scan_regions(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """(region, country, year, cells, models, default_box, geometry) of a region FeatureCollection."""
    features = docs.select(F.explode(F.from_json(F.get_json_object(F.col(doc), "$.features"),
                                                 "array<string>")).alias("_f"))
    props = ("region string, country string, year int, cells int, models array<string>, default_box array<double>")
    return (features.withColumn("_p", F.from_json(F.get_json_object("_f", "$.properties"), props))
            .select("_p.*", F.get_json_object("_f", "$.geometry").alias("geometry")))


def category(role: Column, use: Column) -> Column:
    """Map category of a planned cell."""
    return (F.when(role == "aoi", "aoi").when(F.coalesce(use, F.lit(True)), "ring").otherwise("dropped (water)"))


def cells_to_geojson(cells: DataFrame, epsg: int) -> DataFrame:
    """One GeoJSON Feature text per cell: its closed five-point ring in lon / lat and the display properties."""
    def corner(x: Column, y: Column) -> Column:
        lon, lat = utm_inverse(x, y, F.lit(epsg))
        return F.array(F.round(lon, 7), F.round(lat, 7))

    x0, y1 = F.col("x0"), F.col("y1")
    ring = F.array(corner(x0, y1), corner(x0 + CELL_M, y1), corner(x0 + CELL_M, y1 - CELL_M),
                   corner(x0, y1 - CELL_M), corner(x0, y1))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
        F.struct("cell", "role", category(F.col("role"), F.col("use")).alias("category"),
                 F.round("dist_m", 0).alias("dist_m"), F.round("water", 3).alias("water")).alias("properties"))
    return cells.select("cell", F.to_json(feature).alias("feature"))
