"""The raw-scene chain inside blocks of the cells' grids: what is shuffled, and the same values however the blocks lie."""
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pixelquilt.operators import focal, scene_grid as G
from tests.test_scene_grid import HALO, N, scene, tables

FOLDER = "/root/testdata/sf0.001"


def shuffled_parts(df) -> list[str]:
    """The plan text below every shuffle."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [m.start() if (m := re.search(r"[A-Za-z]", line)) else 0 for line in lines]
    return ["\n".join(lines[i + 1:next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))])
            for i, line in enumerate(lines) if re.search(r"[- ]Exchange (hash|range|Round|Single)", line)]


@pytest.mark.parametrize("name", ["raw_scene_decibels", "raw_scene_composite"])
def test_scene_pixels_are_not_shuffled(spark, name):
    """Scenes, grids and angles are dealt out by block before they become pixels; a block is one row of a literal list."""
    parts = shuffled_parts(entry.queries()[name](spark, FOLDER))
    assert parts
    for part in parts:
        assert "Window" not in part and part.count("Generate explode") == part.count("Generate explode([0])") + part.count("Generate explode(members") + part.count("Generate explode(_m"), part


def test_tasks_grow_in_number_with_the_pixels(spark, monkeypatch):
    pairs = spark.range(40).select(F.col("id").alias("sid"), F.floor(F.col("id") / 2).alias("cell"))
    assert G.grid_parts(pairs, N) == 8                                  # spark.sql.shuffle.partitions
    monkeypatch.setattr(G, "TASK_PIXELS", 36 * 36 * 4)
    assert G.grid_parts(pairs, N) == 10
    monkeypatch.setattr(G, "TASK_PIXELS", 1)
    assert G.grid_parts(pairs, N) == 20                                 # no more than there are blocks


def test_same_values_in_blocks_of_any_size(spark, monkeypatch):
    """Pixels and angles that come plain or dealt out; members without pixels, without acquisition and twice in a set, an
    acquisition that comes twice, a missing angle and a small scene beside the grid's corner."""
    made = [scene(spark, "a", 0.1), scene(spark, "b", 0.3, slope=0.1), scene(spark, "z", 0.2, 32651), scene(spark, "m", 0.05)]
    small = (made[3][0][0], *made[3][0][1:3], 20, 18)
    made[3] = (small, made[3][1].where("r < 20 AND c < 18"))
    mark = (F.col("r") * 5 + F.col("c") * 3) % 23
    made = [(meta, px.withColumn("vv", F.col("vv") + mark / 1000).withColumn("m", F.when(mark == 0, 0.0).when(mark == 7, 0.6).otherwise(1.0))
             .withColumn("elev", F.col("elev") + F.sin(F.col("r") * 0.7) * F.cos(F.col("c") * 0.4))) for meta, px in made]
    args = tables(spark, made, [("a", ["a", "b", "m", "gone"], -10.0), ("b", ["m", "a", "b", "gone"], -11.0), ("z", ["z", "z", "m"], -10.0), ("z", ["a"], -9.0)])
    pixels, scenes, acq, cells, pairs, angles = args
    angles = angles.dropDuplicates(["sid", "cell", "r", "c"]).where("NOT (sid = 'a' AND r = 20 AND c = 20)")

    def found(px, ang):
        rows = G.scene_decibels(px, scenes, acq, cells, pairs, ang, N, HALO).collect()
        return sorted((r["id"], r["t"], r["r"], r["c"], *[None if r[b] is None else round(r[b], 6) for b in ("vv", "vh")]) for r in rows)
    whole = found(pixels, angles)
    assert len(whole) == 4 * N * N - 1 and sum(r[4] is not None for r in whole) > N * N
    # the row is absent, and its neighbours have no slope
    at = {(r[2], r[3]): r[4] for r in whole if r[0] == "a"}
    assert (10, 10) not in at and all(at[p] is None for p in ((9, 10), (11, 10), (10, 9), (10, 11)))
    monkeypatch.setattr(focal, "BLOCK", 11)
    assert found(pixels, angles) == whole
    parts, m = G.grid_parts(pairs, N), N + 2 * HALO
    dealt = G.by_blocks(pairs.distinct(), N, HALO, parts)
    grid = focal.block_pixels(dealt, m, G.REACH).drop("_own")
    assert grid.count() > 4 * m * m
    assert found(pixels.join(dealt, "sid"), grid.join(angles, ["sid", "cell", "r", "c"])) == whole


def test_rows_that_two_rasters_share(spark):
    """A box counts the rows of its own raster, also as carriers of the sums along the rows."""
    px = (spark.range(12 * 12 * 2).select(F.lit("s").alias("id"), F.floor(F.col("id") / 24).alias("r"), (F.floor(F.col("id") / 2) % 12).alias("c"), (F.col("id") % 2 == 0).alias("once"))
          .withColumn("v", F.when(F.col("once"), F.col("r") * 7 % 5 + F.col("c"))).withColumn("elev", F.lit(1.0)))
    want = {(r["r"], r["c"]): r["box_v"] for r in focal.boxcar(px.where("once"), ["id"], ["v"], 3).collect()}
    found = focal.boxcar_and_terrain(px, ["id"], ["v"], 3, "elev", carriers={"v": F.col("once")}).where("once").collect()
    assert len(found) == len(want) and all(r["box_v"] == pytest.approx(want[r["r"], r["c"]]) for r in found)
