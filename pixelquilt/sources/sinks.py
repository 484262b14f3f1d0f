"""Writers of training stacks, mosaics, maps, metric tables and summaries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.layout import mosaic_layout, place_cells
from ..scale import numbered, small
from ..schema import METRIC_COLUMNS, PART_CHIPS, REPORT_SECTIONS


def chip_table(cells: DataFrame, order: list, part_size: int = PART_CHIPS) -> DataFrame:
    """Used cells with global chip id, part (from 1) and row in part, in plan order."""
    return (numbered(cells.where("use"), order, "chip")
            .withColumn("part", (F.floor(F.col("chip") / part_size) + 1).cast("long"))
            .withColumn("row_in_part", F.col("chip") % part_size))


def train_index(chips: DataFrame, labels: DataFrame) -> DataFrame:
    """Chip index with the number of label pixels of every chip (labels: cell, label; NULL = missing)."""
    counts = labels.where("label IS NOT NULL").groupBy("cell").agg(F.count(F.lit(1)).alias("gedi_px"))
    return chips.join(counts, "cell", "left").withColumn("gedi_px", F.coalesce("gedi_px", F.lit(0)))


def write_train_stack(pixels: DataFrame, chips: DataFrame, path: str) -> None:
    """Encoded pixels (cell, r, c, annual, seasonal, label) of the numbered chips, one folder per part; pixels of a
    chip stay in raster order. Partitioned by range, so a task writes few parts and a large part many files."""
    out = pixels.join(small(chips.select("cell", "chip", "part", "row_in_part")), "cell")
    (out.repartitionByRange("part", "chip", "r", "c").sortWithinPartitions("part", "chip", "r", "c")
     .write.partitionBy("part").parquet(path))


def write_mosaic(px: DataFrame, cells: DataFrame, grid: dict, path: str, roles: tuple = ("aoi", "ring")) -> None:
    """Pixels of the laid-out cells, partitioned by mosaic position; cells without pixels are simply absent."""
    layout = mosaic_layout(cells, grid).where(F.col("role").isin(*roles))
    place_cells(px, layout).repartition("mr", "mc").write.partitionBy("mr", "mc").parquet(path)


def _text(v: Column, kind: str) -> Column:
    if kind in ("double", "float"):
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "").otherwise(F.format_string("%.4f", v))
    return F.coalesce(v.cast("string"), F.lit(""))


def metrics_text(metrics: DataFrame) -> DataFrame:
    """Report rows as text: fixed columns, floats with 4 decimals, missing values empty."""
    kinds = dict(metrics.dtypes)
    return metrics.select(*[_text(F.col(c), kinds[c]).alias(c) for c in METRIC_COLUMNS])


def write_metrics_csv(metrics: DataFrame, path: str) -> None:
    """CSV in section order."""
    place = F.array_position(F.array(*[F.lit(s) for s in REPORT_SECTIONS]), F.col("section"))
    (metrics_text(metrics.orderBy(place, "layer")).write.option("header", True).option("emptyValue", "").csv(path))


def _finite(v: Column, kind: str) -> Column:
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v) if kind in ("double", "float") else v


def summary_json(df: DataFrame, name: str = "summary") -> DataFrame:
    """One strict-JSON text per row; non-finite numbers become null."""
    kinds = dict(df.dtypes)
    fields = F.struct(*[_finite(F.col(c), kinds[c]).alias(c) for c in df.columns])
    return df.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias(name))


def write_map(predictions: DataFrame, mask: DataFrame, model: str, path: str) -> None:
    """Prediction table of one model: NULL outside the mask, partitioned by the model tag. A rerun replaces the map of
    this model and leaves those of other models."""
    (materialise_map(predictions, mask, model).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("model").parquet(path))


def materialise_map(predictions: DataFrame, mask: DataFrame, model: str) -> DataFrame:
    inside = mask.select("r", "c").distinct().withColumn("_in", F.lit(True))
    return (predictions.join(inside, ["r", "c"], "left")
            .select("r", "c", F.when(F.col("_in"), F.col("v")).alias("v"), F.lit(model).alias("model")))


__all__ = ["chip_table", "train_index", "write_train_stack", "write_mosaic", "write_metrics_csv", "metrics_text",
           "summary_json", "write_map", "materialise_map"]
