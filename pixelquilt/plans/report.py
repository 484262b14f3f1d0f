"""Accuracy and zonal reports as one table of rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.metrics import (chip_accuracy, chip_keep, chip_summary, finish_paired, paired_accuracy, paired_sums,
                                 zonal_statistics)
from ..scale import small
from ..schema import CELL_PX, LABEL_CAP, METRIC_COLUMNS
from ..session import stash
from .incremental import held_out


def _rows(df: DataFrame, section: str) -> DataFrame:
    kinds = {"n": "bigint", "section": "string", "layer": "string", "note": "string"}
    out = df.withColumn("section", F.lit(section))
    return out.select(*[(F.col(c) if c in out.columns else F.lit(None)).cast(kinds.get(c, "double")).alias(c)
                        for c in METRIC_COLUMNS])


def aligned(layers: DataFrame, mask: DataFrame) -> DataFrame:
    """Layer pixels (layer, r, c, v) inside the mask."""
    return layers.join(mask.select("r", "c"), ["r", "c"], "left_semi").where("v IS NOT NULL")


def on_mosaic_grid(meta: DataFrame) -> DataFrame:
    """(layer, note): layers whose grid (epsg, x0, y1, width, height) is not that of the mask ('mask' row) are left
    out with a note."""
    grid = ["epsg", "x0", "y1", "width", "height"]
    ref = meta.where("layer = 'mask'").select(F.struct(*grid).alias("g")).scalar()
    return (meta.where("layer <> 'mask'").withColumn("_g", ref)
            .select("layer", F.when(F.struct(*grid) == F.col("_g"), "").otherwise("not on the mosaic grid, left out")
                    .alias("note")))


def study_area_section(layers: DataFrame, mask: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of every layer inside the mask and its agreement with the labels (0, 80], in one aggregation over
    the pixels; a labels row with the number of labels above the cap."""
    inside = stash(mask.select("r", "c").distinct(), "mask")           # two columns, read for every part below
    lab = stash(aligned(labels.withColumn("layer", F.lit("GEDI")), inside), "labels")
    good = lab.where((F.col("v") > 0) & (F.col("v") <= LABEL_CAP))
    over = lab.agg(F.count_if(F.col("v") > LABEL_CAP).alias("n")).scalar()
    pairs = layers.join(good.select("r", "c", F.col("v").alias("ref")), ["r", "c"], "left")
    stats = finish_paired(zonal_statistics(pairs, inside, paired_sums("v", "ref")))
    label_row = (zonal_statistics(good, inside).withColumnRenamed("n_px", "n")
                 .withColumn("note", F.format_string("%d labels above the cap left out", over)))
    return _rows(stats.withColumn("note", F.lit("")), "study_area").unionByName(_rows(label_row, "study_area"))


def reference_section(layers: DataFrame, mask: DataFrame, reference: DataFrame, tile: int = CELL_PX,
                      min_share: float = 0.01) -> DataFrame:
    """Chip accuracy of every layer against the reference heights: the same kept chips for every layer; n and bias
    pooled, rmse and r2 chip medians."""
    ref = stash(aligned(reference.withColumn("layer", F.lit("ALS")), mask).drop("layer"), "reference")
    chips = stash(chip_keep(ref, min_share, tile), "kept")
    dropped = chips.agg(F.count_if(~F.col("kept")).alias("n")).scalar()
    kept = chips.where("kept").select("cr", "cc")
    cells = (ref.withColumn("cr", F.floor(F.col("r") / tile)).withColumn("cc", F.floor(F.col("c") / tile))
             .join(kept, ["cr", "cc"], "left_semi").withColumnRenamed("v", "ref"))
    # every reference cell once per layer (the layer names are an array, one entry per layer); a layer without a
    # value there counts as 0 in the evaluation
    listed = layers.agg(F.collect_set("layer").alias("l")).scalar()
    px = (cells.withColumn("layer", F.explode(listed))
          .join(layers.select("layer", "r", "c", F.col("v").alias("pred")), ["layer", "r", "c"], "left"))
    out = (chip_summary(chip_accuracy(px, ["layer", "cr", "cc"]), ["layer"])
           .select("layer", F.col("n_px").alias("n"), F.col("rmse_median").alias("rmse"),
                   F.col("me_pooled").alias("bias"), F.col("r2_median").alias("r2"),
                   F.format_string("%d chips, %d with too few cells left out", "n_chips", dropped).alias("note")))
    return _rows(out, "als")


def zonal_report(layers: DataFrame, mask: DataFrame, labels: DataFrame, reference: DataFrame | None = None,
                 tile: int = CELL_PX, min_share: float = 0.01) -> DataFrame:
    out = study_area_section(layers, mask, labels)
    return out if reference is None else out.unionByName(reference_section(layers, mask, reference, tile, min_share))


def validation_section(predictions: DataFrame, validation: DataFrame, labels: DataFrame,
                       currency: DataFrame) -> DataFrame:
    """Accuracy of every current model on the labels (0, 80] of the validation chips; missing predictions are dropped.

    predictions: model, chip, r, c, pred; labels: chip, r, c, label; currency: model, current, reason. Chips
    and current models are written and counted: up to SMALL_ROWS are broadcast, so no prediction is shuffled by its model,
    and none of another chip at all.
    """
    chips = small(stash(validation.select("chip").distinct(), "chips"))
    lab = labels.join(chips, "chip", "left_semi").where((F.col("label") > 0) & (F.col("label") <= LABEL_CAP))
    current = small(stash(currency.where("current").select("model"), "current"))
    pairs = (predictions.join(current, "model", "left_semi").join(chips, "chip", "left_semi").join(lab, ["chip", "r", "c"])
             .select("model", "pred", F.col("label").alias("ref")))
    scored = paired_accuracy(pairs, ["model"]).withColumnRenamed("model", "layer").withColumn("note", F.lit(""))
    return _rows(scored, "gedi_val")


def within_stack(currency: DataFrame, splits: DataFrame, n_chips: Column | int) -> DataFrame:
    """currency (model, current, reason) with the models that are not current because their split (model, chip, part)
    names chips beyond the `n_chips` of the stack."""
    last = splits.groupBy("model").agg(F.max("chip").alias("_last"))
    beyond = F.coalesce(F.col("_last") >= n_chips, F.lit(False)) & F.col("current")
    return (currency.join(last, "model", "left")
            .select("model", (F.col("current") & ~beyond).alias("current"),
                    F.when(beyond, "split beyond the stack").otherwise(F.col("reason")).alias("reason")))


def validation_chips(currency: DataFrame, splits: DataFrame, recipe: DataFrame, main: str) -> DataFrame:
    """chip: the validation part of the main model's split if that model is current and has one, else of the recipe's
    (chip, part)."""
    usable = currency.where("current").where(F.col("model") == main).agg(F.count(F.lit(1))).scalar()
    own = splits.where((F.col("model") == main) & (usable > 0))
    found = own.agg(F.count(F.lit(1))).scalar()
    return (own.select("chip", "part").unionByName(recipe.where(found == 0).select("chip", "part"))
            .where("part = 'val'").select("chip").distinct())


def validation_scoring(predictions: DataFrame, labels: DataFrame, currency: DataFrame, splits: DataFrame, recipe: DataFrame,
                       n_chips: Column | int, main: str, in_sample: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(scores, labels used) of the validation chips.

    scores: layer, n, rmse, bias, r2, own (validation chips the model was trained on), note; a model that is not
    scored has only a note, its reason. in_sample: models that are fitted on pixels of all chips.
    labels used: n_chips, n_labels, n_over (left out above LABEL_CAP)."""
    checked = within_stack(currency, splits, n_chips)
    chips = validation_chips(checked, splits, recipe, main)
    scored = validation_section(predictions, chips, labels, checked).select("layer", "n", "rmse", "bias", "r2")
    seen = held_out(splits.where("part = 'train'").select("model", "chip"), chips, checked.where("current"))
    status = F.when(F.col("model").isin(*in_sample), "in-sample").otherwise(F.col("status")) if in_sample else F.col("status")
    noted = checked.join(seen.select("model", F.col("overlap").alias("own"), status.alias("status")), "model", "left")
    scores = (noted.select(F.col("model").alias("layer"), "own", F.when(F.col("current"), F.col("status")).otherwise(F.col("reason")).alias("note"))
              .join(scored, "layer", "left").select("layer", "n", "rmse", "bias", "r2", "own", "note"))
    on_chips = labels.join(chips, "chip", "left_semi").agg(
        F.count_if((F.col("label") > 0) & (F.col("label") <= LABEL_CAP)).alias("n_labels"), F.count_if(F.col("label") > LABEL_CAP).alias("n_over"))
    return scores, on_chips.withColumn("n_chips", chips.agg(F.count(F.lit(1))).scalar()).select("n_chips", "n_labels", "n_over")
