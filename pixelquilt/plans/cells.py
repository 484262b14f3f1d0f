"""Study-area and training cells."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import CELL_CATEGORIES, CELL_PX
from ..session import stash
from ..sources.geojson import category

# fixed values: planning rules and cost figures
MIN_AREA = 1.0
RING_STEP = 1000.0
FEW_PIXELS = 100
STACK_BYTES_PER_CELL = (76 * 2 + 4) * CELL_PX ** 2
FOREST_BYTES_PER_CELL = 9.6e6
REFERENCE_CELLS = 400


def plan_order() -> list[Column]:
    """Study-area cells from the north-west row by row, then the ring by distance."""
    ring = F.col("role") != "aoi"
    return [ring, F.when(ring, F.col("dist_m")).otherwise(0), F.desc("y1"), "x0"]


def upsert_landcover(cache: DataFrame, lookup: DataFrame, cells: DataFrame) -> DataFrame:
    """Land cover of the cells: the cache (cell, water, built, tree, ord) keeps the last entry of a cell, only cells
    it lacks are taken from the lookup (cell, water, built, tree)."""
    shares = ["water", "built", "tree"]
    kept = (cache.groupBy("cell").agg(F.max_by(F.struct(*shares), "ord").alias("_s"))
            .select("cell", *[F.col(f"_s.{s}").alias(s) for s in shares]))
    missing = cells.select("cell").distinct().join(kept, "cell", "left_anti")
    return kept.unionByName(lookup.select("cell", *shares).join(missing, "cell", "left_semi"))


def ring_distance(cells: DataFrame, train_cells: int, ring_max_km: float, water_max: float) -> DataFrame:
    """One row (n_aoi, D, usable): the smallest whole-kilometre distance with enough usable cells, the cap if there
    are never enough, NULL when the study area alone has enough. cells: area, dist, water.

    The growing loop is one running sum over at most cap / 1 km + 1 distance steps. `cells` is read twice: pass a
    table, not a long computation (plan_cells does).
    """
    cap = max(ring_max_km * 1000.0, 0.0)
    aoi = F.col("area") >= MIN_AREA
    usable = ~F.coalesce(F.col("water") >= water_max, F.lit(False))
    dist = F.rint("dist")
    step = F.least(F.ceil(dist / RING_STEP) * RING_STEP, F.lit(cap))
    n_aoi = cells.agg(F.count_if(aoi).alias("n"))
    steps = (cells.where(~aoi & (dist <= cap)).groupBy(step.alias("step")).agg(F.count_if(usable).alias("usable"))
             .withColumn("have", F.sum("usable").over(
                 Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)) + n_aoi.scalar()))
    found = steps.agg(F.min(F.when(F.col("have") >= train_cells, F.col("step"))).alias("d"),
                      F.max("have").alias("most"),
                      F.min(F.when(F.col("have") >= train_cells, F.col("have"))).alias("have"))
    enough = F.col("n_aoi") >= train_cells
    return (found.withColumn("n_aoi", n_aoi.scalar())
            .select("n_aoi", F.when(~enough, F.coalesce("d", F.lit(cap))).alias("D"),
                    F.when(enough, F.col("n_aoi")).otherwise(F.coalesce("have", "most", "n_aoi")).alias("usable")))


def plan_cells(cells: DataFrame, train_cells: int = 400, ring_max_km: float = 50.0,
               water_max: float = 0.95) -> DataFrame:
    """Study-area cells (overlap of at least 1 m2) and the ring cells within the ring distance; ring cells that are
    mostly water stay in the plan with use = false."""
    cells = stash(cells, "cells")
    D = ring_distance(cells, train_cells, ring_max_km, water_max).select("D")
    aoi = F.col("area") >= MIN_AREA
    dist = F.rint("dist").cast("int")
    kept = cells.withColumn("_d", D.scalar()).where(aoi | (dist <= F.col("_d")))
    role = F.when(aoi, "aoi").otherwise("ring")
    use = aoi | ~F.coalesce(F.col("water") >= water_max, F.lit(False))
    return kept.withColumn("role", role).withColumn("dist_m", F.when(aoi, 0).otherwise(dist)) \
        .withColumn("use", use).drop("_d", "area", "dist")


def area_only_plan(cells: DataFrame) -> DataFrame:
    """Plan without ring or land cover, for an area of any size."""
    none = F.lit(None).cast("double")
    kept = cells.where(F.col("area") >= MIN_AREA)
    return (kept.withColumn("role", F.lit("aoi")).withColumn("dist_m", F.lit(0)).withColumn("water", none)
            .withColumn("built", none).withColumn("tree", none).withColumn("use", F.lit(True)).drop("area", "dist"))


def plan_notes(n_aoi: int, n_pixels: int, train_cells: int) -> list[tuple[str, str]]:
    """(level, text) of what is wrong or remarkable about a study area."""
    notes = []
    if n_aoi == 0:
        notes.append(("error", "the study area covers less than 1 m2 of every grid cell"))
    elif n_pixels == 0:
        notes.append(("error", "the study area covers no pixel centre"))
    elif n_pixels < FEW_PIXELS:
        notes.append(("warning", f"the study area covers only {n_pixels} pixels"))
    if n_aoi > train_cells:
        cost = training_cost(n_aoi)
        notes.append(("warning", f"{n_aoi} study-area cells are all used for training "
                                 f"(stack about {cost['stack_gb']:.0f} GB)"))
    return notes


def training_cost(n_cells: int) -> dict:
    return dict(stack_gb=n_cells * STACK_BYTES_PER_CELL / 1e9, rf_gb=n_cells * FOREST_BYTES_PER_CELL / 1e9,
                unet_x=n_cells / REFERENCE_CELLS)


def category_counts(cells: DataFrame) -> DataFrame:
    """Cells per map category; every category has a row, in fixed order (pos)."""
    labels = F.array(*[F.lit(c) for c in CELL_CATEGORIES])
    found = cells.groupBy(category(F.col("role"), F.col("use")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    every = cells.sparkSession.range(len(CELL_CATEGORIES)).select(
        F.col("id").alias("pos"), labels[F.col("id").cast("int")].alias("category"))
    return every.join(found, "category", "left").select("pos", "category", F.coalesce("n", F.lit(0)).alias("n"))
