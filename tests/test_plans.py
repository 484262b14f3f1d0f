"""The physical plans the operators are meant to have."""
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pixelquilt.operators.blocks import block_percentile
from pixelquilt.operators.composite import join_masks
from pixelquilt.operators.focal import boxcar, boxcar_and_terrain
from pixelquilt.operators.metrics import chip_accuracy
from pixelquilt.scale import small

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(text):
    return len(re.findall(r"Exchange hashpartitioning", text))


def test_seasonal_composite_shuffles_observations_once(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    text = plan(entry.queries()["seasonal_composite"](spark, FOLDER))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "BroadcastHashJoin [sid" in text and "SortMergeJoin" not in text
    scan = next(x for x in text.splitlines() if "lineitem.parquet" in x)
    assert "GreaterThanOrEqual(l_shipdate" in scan and "LessThan(l_shipdate" in scan
    assert "l_linenumber" not in scan and "l_linestatus" not in scan
    assert shuffles(text) == 2                              # scenes by id, observations by pixel and season


def test_broadcast_has_another_way(spark):
    a = spark.range(1000).select((F.col("id") % 10).alias("sid"), "id")
    masks = spark.range(20).select(F.col("id").alias("sid"), F.col("id").alias("cloud"))
    assert small(masks, rows=20)._jdf.queryExecution().logical().toString() != masks._jdf.queryExecution().logical().toString()
    assert small(masks, rows=19) is masks
    assert join_masks(a, masks).count() == 1000


@pytest.mark.parametrize("build,count", [
    (lambda s, px: block_percentile(px, 10, {"p": 0.9}), 1),
    (lambda s, px: chip_accuracy(px.select(F.col("r").alias("chip"), F.col("v").alias("pred"), F.col("v").alias("ref"))), 1),
    (lambda s, px: boxcar(px, ["k"], ["v", "w"]), 1),
    (lambda s, px: boxcar_and_terrain(px, ["k"], ["v", "w"], 15, "v"), 1),
])
def test_shuffle_counts(spark, build, count):
    px = spark.range(100).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 10).alias("r"), (F.col("id") % 10).alias("c"),
                                 F.rand(1).alias("v"), F.rand(2).alias("w"))
    assert shuffles(plan(build(spark, px))) == count


@pytest.mark.parametrize("name", ["box_filter", "box_filter_sparse", "terrain_slopes", "image_gradients", "gradient_agreement",
                                  "member_sums", "acquisition_decibels"])
def test_focal_windows_stay_in_a_block(spark, name):
    """No window holds a whole raster row or column."""
    windows = re.findall(r"Window \[.*?\], \[(.*?)\], \[", plan(entry.queries()[name](spark, FOLDER)))
    assert windows and all("_br" in w and "_bc" in w for w in windows)


def test_no_python_in_the_hot_path(spark):
    for name in ("annual_composite", "chip_accuracy", "annual_radar", "bilinear_resample", "blended_prediction", "histogram_medians"):
        text = plan(entry.queries()[name](spark, FOLDER))
        assert "Python" not in text and "ArrowEval" not in text, name


@pytest.mark.parametrize("name", ["annual_radar", "seasonal_radar"])
def test_radar_scenes_are_put_together_once(spark, name):
    """The pixels take their scenes from one written row: no join is planned, and none broadcast, for the chain."""
    text = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().toString()
    assert "Join" not in text
