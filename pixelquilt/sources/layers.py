"""Layer pixels, cells, chips and observations."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..schema import CELL_PX, CELLS, LAYER_PIXELS, ORIGIN_TOLERANCE, RES


def scan_layer(spark: SparkSession, path: str, layer: str, bands: list[str] | None = None) -> DataFrame:
    """Pixels of one layer from a table partitioned by layer: partition and row-group pruned, declared schema."""
    px = spark.read.schema(LAYER_PIXELS).parquet(path).where(F.col("layer") == layer)
    return px.where(F.col("band").isin(*bands)) if bands else px


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("true", "1", "1.0", "yes"), F.lit(False))


def clean_cells(cells: DataFrame) -> DataFrame:
    """`use` parsed from text (absent: used), role defaults to ring."""
    use = truthy(F.col("use").cast("string")) if "use" in cells.columns else F.lit(True)
    role = F.coalesce(F.col("role"), F.lit("ring")) if "role" in cells.columns else F.lit("ring")
    return cells.withColumn("use", use).withColumn("role", role)


def scan_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cell plan as CSV with a fixed schema; `ord` keeps the file order (increasing, not consecutive)."""
    raw = spark.read.schema(CELLS).option("header", True).csv(path)
    return clean_cells(raw.withColumn("ord", F.monotonically_increasing_id()))


def check_grid(px: DataFrame, cells: DataFrame, bands: dict[str, list[str]], size: int = CELL_PX) -> DataFrame:
    """Violations (cell, layer, reason) of a layer pixel table (cell, layer, band, epsg, r, c, x, y) against the plan
    (cell, x0, y1, epsg). x, y are pixel centres; every band needs size x size pixels on the 10 m grid."""
    per_band = px.groupBy("cell", "layer", "band").agg(
        F.count(F.lit(1)).alias("n"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"),
        F.max("c").alias("c1"), F.min("x").alias("xa"), F.max("x").alias("xb"), F.min("y").alias("ya"),
        F.max("y").alias("yb"), F.min("epsg").alias("e0"), F.max("epsg").alias("e1"))
    found = per_band.groupBy("cell", "layer").agg(
        F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("r0").alias("r0"), F.max("r1").alias("r1"),
        F.min("c0").alias("c0"), F.max("c1").alias("c1"), F.min("xa").alias("xa"), F.max("xb").alias("xb"),
        F.min("ya").alias("ya"), F.max("yb").alias("yb"), F.min("e0").alias("e0"), F.max("e1").alias("e1"),
        F.sort_array(F.collect_set("band")).alias("bands"))          # one entry per band of the layer
    expected = F.create_map(*[x for k, v in bands.items()
                              for x in (F.lit(k), F.array(*[F.lit(b) for b in sorted(v)]))])
    whole = ((F.col("n0") == size * size) & (F.col("n1") == size * size) & (F.col("r0") == 0) & (F.col("c0") == 0)
             & (F.col("r1") == size - 1) & (F.col("c1") == size - 1))
    origin = ((F.abs(F.col("xa") - RES / 2 - F.col("x0")) <= ORIGIN_TOLERANCE)
              & (F.abs(F.col("yb") + RES / 2 - F.col("y1")) <= ORIGIN_TOLERANCE))
    step = ((F.abs(F.col("xb") - F.col("xa") - RES * (size - 1)) <= 1e-6)
            & (F.abs(F.col("yb") - F.col("ya") - RES * (size - 1)) <= 1e-6))
    epsg = (F.col("e0") == F.col("epsg")) & (F.col("e1") == F.col("epsg"))
    reason = (F.when(F.col("x0").isNull(), "unknown cell").when(~whole, "not one whole cell")
              .when(~origin, "origin").when(~step, "resolution").when(~epsg, "epsg")
              .when(F.col("bands") != expected[F.col("layer")], "bands"))
    plan = cells.select("cell", "x0", "y1", "epsg")
    return (found.join(plan, "cell", "left").withColumn("reason", reason).where("reason IS NOT NULL")
            .select("cell", "layer", "reason"))


def chip_offsets(chips: DataFrame) -> DataFrame:
    """(part, size, first): chips per part and the global id of its first chip. One row per part file."""
    sizes = chips.groupBy("part").agg((F.max("row_in_part") + 1).cast("long").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("first", F.coalesce(F.sum("size").over(before), F.lit(0)))


def scan_chips(chips: DataFrame, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Parts (part, row_in_part, ...) as one collection with a global `chip`, optionally a contiguous slice."""
    out = (chips.join(chip_offsets(chips).select("part", "first"), "part")
           .withColumn("chip", F.col("first") + F.col("row_in_part")).drop("first"))
    if start is not None:
        out = out.where(F.col("chip") >= start)
    return out if stop is None else out.where(F.col("chip") < stop)


def scan_observations(obs: DataFrame, start: str, end: str, bounds: tuple | None = None) -> DataFrame:
    """Observations with start <= t < end and pixels inside (r0, r1, c0, c1); plain predicates, so they reach the
    scan and prune date partitions."""
    out = obs.where((F.col("t") >= F.lit(start).cast("timestamp_ntz")) & (F.col("t") < F.lit(end).cast("timestamp_ntz")))
    if bounds is None:
        return out
    r0, r1, c0, c1 = bounds
    return out.where(F.col("r").between(r0, r1) & F.col("c").between(c0, c1))


def clip_to_cells(px: DataFrame, cells: DataFrame) -> DataFrame:
    """Pixels of the listed cells only."""
    return px.join(cells.select("cell").distinct(), "cell", "left_semi")
