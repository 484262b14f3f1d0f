"""Readers, writers, incremental bookkeeping and streams on small tables."""
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelquilt.plans import incremental as I
from pixelquilt.session import fresh_path, shared_dir, stash
from pixelquilt.sources.geojson import cells_to_geojson, scan_polygons
from pixelquilt.sources.layers import scan_cells, scan_layer
from pixelquilt.streaming import jobs as J

BOX = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
HOLE = [[2, 2], [2, 4], [4, 4], [4, 2], [2, 2]]


def docs(spark, *objects):
    return spark.createDataFrame([(i, json.dumps(o)) for i, o in enumerate(objects)], "id int, doc string")


def test_geojson_forms(spark):
    poly = {"type": "Polygon", "coordinates": [BOX, HOLE]}
    multi = {"type": "MultiPolygon", "coordinates": [[BOX], [[[20, 0, 5], [30, 0, 5], [30, 10, 5], [20, 0, 5]]]]}
    nested = {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 1]},
                                                           {"type": "GeometryCollection", "geometries": [poly]}]}
    feature = {"type": "Feature", "properties": {"a": 1}, "geometry": multi}
    fc = {"type": "FeatureCollection", "features": [feature, {"type": "Feature", "geometry": None, "properties": {}},
                                                    {"type": "Feature", "properties": {}, "geometry": nested}]}
    line = {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}
    edges = scan_polygons(docs(spark, poly, multi, nested, feature, fc, line))
    n = {r["id"]: (r["n"], r["parts"], r["holes"]) for r in edges.groupBy("id").agg(
        F.count("*").alias("n"), F.countDistinct("part").alias("parts"), F.count_if("hole").alias("holes")).collect()}
    assert n == {0: (8, 1, 4), 1: (7, 2, 0), 2: (8, 1, 4), 3: (7, 2, 0), 4: (15, 3, 4)}
    first = edges.where("id = 0 AND ring = 0 AND seq = 0").first()
    assert (first["x1"], first["y1"], first["x2"], first["y2"]) == (0, 0, 10, 0)
    with pytest.raises(Exception, match="not a GeoJSON object"):
        scan_polygons(docs(spark, {"type": "Topology"})).collect()


def test_cell_features_are_closed_rings(spark):
    cells = spark.createDataFrame([("x584670y550110", "ring", 570, 0.97, 584670.0, 550110.0, False)],
                                  "cell string, role string, dist_m int, water double, x0 double, y1 double, use boolean")
    f = json.loads(cells_to_geojson(cells, 32650).first()["feature"])
    ring = f["geometry"]["coordinates"][0]
    assert f["type"] == "Feature" and len(ring) == 5 and ring[0] == ring[-1]
    assert ring[0][0] == pytest.approx(117.763, abs=0.01) and ring[0][1] == pytest.approx(4.976, abs=0.01)
    assert f["properties"]["category"] == "dropped (water)"


def test_scan_prunes_partitions_and_columns(spark):
    path = fresh_path(spark, "layers")
    px = spark.range(100).select(F.lit("a").alias("cell"), F.col("id").cast("int").alias("r"), F.lit(0).alias("c"),
                                 F.element_at(F.array(F.lit("VV"), F.lit("VH")), (F.col("id") % 2 + 1).cast("int")).alias("band"),
                                 F.col("id").cast("double").alias("v"),
                                 F.when(F.col("id") < 60, "S1").otherwise("S2").alias("layer"))
    px.write.partitionBy("layer").parquet(path)
    out = scan_layer(spark, path, "S1", ["VH"]).select("v")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(layer" in plan and "PushedFilters: [IsNotNull(band), EqualTo(band,VH)]" in plan
    assert "ReadSchema: struct<band:string,v:double>" in plan and out.count() == 30


def test_cells_without_optional_columns(spark):
    path = fresh_path(spark, "cells")
    spark.createDataFrame([("c1", "", "TRUE"), ("c2", "aoi", ""), ("c3", "aoi", "no"), ("c4", "ring", " Yes")],
                          "cell string, role string, use string").select(
        "cell", *[F.lit(0).alias(c) for c in ("x0", "y1", "col", "row")], "role", *[F.lit(0).alias(c) for c in ("dist_m", "water", "built", "tree")],
        "use").coalesce(1).write.option("header", True).csv(path)
    got = {r["cell"]: (r["role"], r["use"]) for r in scan_cells(spark, path).collect()}
    assert got == {"c1": ("ring", True), "c2": ("aoi", False), "c3": ("aoi", False), "c4": ("ring", True)}


def test_fingerprints_with_missing_values(spark):
    old = spark.createDataFrame([("a", 1, 5), ("b", None, 5), ("c", 1, 5), ("d", 1, None)], "key string, size int, mtime int")
    new = spark.createDataFrame([("a", 1, 6), ("b", None, 5), ("e", 1, 5), ("d", 1, None)], "key string, size int, mtime int")
    assert {r["key"]: r["change"] for r in I.fingerprint_diff(old, new).collect()} == {"a": "changed", "c": "missing", "e": "new"}


def test_content_hash_ignores_order_and_sees_copies(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("part"), F.col("id").cast("string").alias("x"))
    h = lambda d: {r["part"]: r["hash"] for r in I.content_hash(d, ["part"], F.col("x")).collect()}        # noqa: E731
    base = h(df)
    assert h(df.orderBy(F.desc("x")).repartition(5)) == base
    assert h(df.union(df.where("x = '0'")))[0] != base[0] and h(df.where("x <> '1'"))[1] != base[1]


def test_incomplete_stack_and_models(spark):
    stack = spark.createDataFrame([(None, "AE", 5, 2, "p", "", None)], "stack_id string, input string, labels int, chips int, parts string, "
                                  "seasonal_parts string, teacher_id string")
    model = spark.createDataFrame([("m", "forest", True, True, None, "I", 5, 2, "p", "", None)],
                                  "model string, kind string, file_exists boolean, finished boolean, run_stack_id string, input string, n_rows int, "
                                  "n_chips int, parts string, seasonal_parts string, teacher_id string")
    assert I.model_currency(model, stack).first()["reason"] == "the training stack is incomplete"
    full = stack.withColumn("stack_id", F.lit("s"))
    assert I.model_currency(model, full).first()["reason"] == "trained with input A"
    assert I.model_currency(model.withColumn("input", F.lit("IE")), full).first()["current"]


def test_stash_lives_in_the_shared_folder(spark):
    df = stash(spark.range(10), "t")
    assert df.count() == 10 and all(f.startswith(("file:", "/")) and shared_dir(spark).split(":")[-1] in f for f in df.inputFiles())


def write_batch(spark, path, rows):
    spark.createDataFrame(rows, "id long, t timestamp, k string, p double, y double").coalesce(1).write.mode("append").parquet(path)


def test_streams_resume(spark):
    import datetime as dt
    src, out, mark = (fresh_path(spark, x) for x in ("in", "out", "mark"))
    day = lambda d: dt.datetime(2024, 1, d, tzinfo=dt.timezone.utc)              # noqa: E731
    write_batch(spark, src, [(1, day(1), "a", 1.0, 2.0), (2, day(2), "a", 3.0, 3.5), (2, day(2), "a", 3.0, 3.5)])
    schema = spark.read.parquet(src).schema

    def run_all():
        s = J.observations(spark, src, schema)
        J.ingest(s, ["id"], out + "/i", mark + "/i")
        J.running_statistics(s, "t", ["k"], "p", "1 day", out + "/s", mark + "/s")
        J.running_accuracy(s, ["k"], F.col("p"), F.col("y"), out + "/a", mark + "/a")
    run_all()
    assert sorted(r["id"] for r in spark.read.parquet(out + "/i").collect()) == [1, 2]
    write_batch(spark, src, [(3, day(2), "a", 5.0, 4.0), (2, day(2), "a", 3.0, 3.5), (4, day(3), "b", 1.0, None)])
    run_all()
    run_all()                                                                    # nothing new: nothing changes
    assert sorted(r["id"] for r in spark.read.parquet(out + "/i").collect()) == [1, 2, 3, 4]
    stats = {(r["k"], r["start"].day): (r["n"], r["mean"]) for r in J.statistics(spark, out + "/s", ["k"]).collect()}
    assert stats == {("a", 1): (1, 1.0), ("a", 2): (4, 3.5), ("b", 3): (1, 1.0)}
    acc = J.accuracy(spark, out + "/a", ["k"]).collect()
    assert acc[0]["r2"] == pytest.approx(np.corrcoef([1, 3, 3, 5, 3], [2, 3.5, 3.5, 4, 3.5])[0, 1] ** 2)
    assert len(acc) == 1 and acc[0]["n"] == 5 and acc[0]["me"] == pytest.approx((-1 - 0.5 - 0.5 + 1 - 0.5) / 5)


def test_a_back_filled_file_arrives(spark):
    """A file with observations two months older than those ingested is ingested, and counted, all the same."""
    import datetime as dt
    src, out, mark = (fresh_path(spark, x) for x in ("in", "out", "mark"))
    day = lambda m, d: dt.datetime(2024, m, d, tzinfo=dt.timezone.utc)           # noqa: E731
    write_batch(spark, src, [(1, day(3, 2), "a", 1.0, 2.0), (2, day(3, 3), "a", 2.0, 2.0)])
    schema = spark.read.parquet(src).schema
    for i in range(3):
        s = J.observations(spark, src, schema, files_per_batch=1)
        J.ingest(s, ["id"], out + "/i", mark + "/i")
        J.running_statistics(s, "t", ["k"], "p", "1 day", out + "/s", mark + "/s")
        if i == 0:
            write_batch(spark, src, [(3, day(1, 1), "a", 7.0, 2.0), (4, day(3, 3), "a", 4.0, 2.0), (1, day(3, 2), "a", 1.0, 2.0)])
    assert sorted(r["id"] for r in spark.read.parquet(out + "/i").collect()) == [1, 2, 3, 4]
    stats = {(r["start"].month, r["start"].day): (r["n"], r["mean"], r["variance"]) for r in J.statistics(spark, out + "/s", ["k"]).collect()}
    assert stats == {(1, 1): (1, 7.0, 0.0), (3, 2): (2, 1.0, 0.0), (3, 3): (2, 3.0, 1.0)}


def test_map_written_twice(spark, tmp_path):
    from pixelquilt.sources.sinks import write_map
    px = spark.createDataFrame([(0, 0, 1.5), (0, 1, 2.5)], "r int, c int, v double")
    mask = spark.createDataFrame([(0, 0)], "r int, c int")
    for model in ("a", "b", "a"):
        write_map(px, mask, model, str(tmp_path / "maps"))
    got = sorted((r["model"], r["c"], r["v"]) for r in spark.read.parquet(str(tmp_path / "maps")).collect())
    assert got == [("a", 0, 1.5), ("a", 1, None), ("b", 0, 1.5), ("b", 1, None)]
