"""Accuracy and zonal statistics as mergeable aggregates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..scale import group_quantiles
from ..schema import CELL_PX, LABEL_CAP
from ..session import stash

# fixed values: evaluation conventions
MIN_SHARE = 0.01


def _r2(pred: str, ref: str) -> Column:
    """Squared Pearson correlation from centred moments; NULL when a variance is 0 (never `corr`, which fails)."""
    vx, vy, cov = F.var_pop(ref), F.var_pop(pred), F.covar_pop(pred, ref)
    return F.when((vx > 0) & (vy > 0), cov * cov / F.when((vx > 0) & (vy > 0), vx * vy))


def pooled_accuracy(pairs: DataFrame, keys: list[str] = (), pred: str = "pred", ref: str = "ref") -> DataFrame:
    """n_px, me, rmse, r2 over all pairs; a group without pairs gives no row."""
    d = F.col(pred) - F.col(ref)
    return (pairs.where(F.col(pred).isNotNull() & F.col(ref).isNotNull()).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n_px"), F.avg(d).alias("me"), F.sqrt(F.avg(d * d)).alias("rmse"),
                 _r2(pred, ref).alias("r2")).where("n_px > 0"))


def paired_sums(pred: str = "pred", ref: str = "ref") -> list[Column]:
    """Aggregates of complete pairs for finish_paired."""
    both = F.col(pred).isNotNull() & F.col(ref).isNotNull()
    p, t = F.when(both, F.col(pred)), F.when(both, F.col(ref))
    return [F.count_if(both).alias("n"), F.avg(p - t).alias("bias"), F.sqrt(F.avg((p - t) * (p - t))).alias("rmse"),
            F.avg(p).alias("_mp"), F.avg(t).alias("_mt"), F.var_pop(p).alias("_vp"), F.var_pop(t).alias("_vt"),
            F.covar_pop(p, t).alias("_c")]


def finish_paired(sums: DataFrame) -> DataFrame:
    """r2 from the moments: capped at 1, missing when a variance is at rounding level."""
    spread = ((F.col("n") > 1) & (F.col("_vp") > 1e-12 * (1 + F.col("_mp") * F.col("_mp")))
              & (F.col("_vt") > 1e-12 * (1 + F.col("_mt") * F.col("_mt"))))
    r2 = F.when(spread, F.least(F.lit(1.0), F.col("_c") * F.col("_c") / F.when(spread, F.col("_vp") * F.col("_vt"))))
    return sums.withColumn("r2", r2).drop("_mp", "_mt", "_vp", "_vt", "_c")


def paired_accuracy(pairs: DataFrame, keys: list[str] = (), pred: str = "pred", ref: str = "ref") -> DataFrame:
    """n, rmse, bias, r2 of complete pairs. No pairs: n = 0."""
    return finish_paired(pairs.groupBy(*keys).agg(*paired_sums(pred, ref))).select(*keys, "n", "rmse", "bias", "r2")


def flat_accuracy(pairs: DataFrame, keys: list[str] = (), pred: str = "pred", ref: str = "ref") -> DataFrame:
    """n, r2, rmse, bias, mae of complete pairs."""
    d = F.col(pred) - F.col(ref)
    return (pairs.where(F.col(pred).isNotNull() & F.col(ref).isNotNull()).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n"), _r2(pred, ref).alias("r2"), F.sqrt(F.avg(d * d)).alias("rmse"),
                 F.avg(d).alias("bias"), F.avg(F.abs(d)).alias("mae")))


def evaluated_pairs(px: DataFrame, cap80: bool = True, mask_ref: str | None = None) -> DataFrame:
    """Pixels that count in the chip evaluation (pred, ref). The mask reference (default: the reference itself)
    counts as 0 when missing, negative, above the cap or below 1; cells above 1 are evaluated. With a separate mask
    reference the value is the uncapped reference and cells missing it are dropped. Missing predictions are 0."""
    lab = F.coalesce(F.col(mask_ref or "ref"), F.lit(0.0))
    lab = F.when((lab < 0) | (lab < 1), F.lit(0.0)).otherwise(lab)
    if cap80:
        lab = F.when(lab > LABEL_CAP, F.lit(0.0)).otherwise(lab)
    kept = px.withColumn("_lab", lab).where("_lab > 1")
    if mask_ref:
        kept = kept.where(F.col("ref").isNotNull() & (F.col("ref") != -999))
    else:
        kept = kept.withColumn("ref", F.col("_lab"))
    return kept.withColumn("pred", F.coalesce("pred", F.lit(0.0))).drop("_lab")


def chip_accuracy(px: DataFrame, keys: list[str] = ("chip",), cap80: bool = True,
                  mask_ref: str | None = None) -> DataFrame:
    """Per chip: n, rmse, mae, me, r2; chips without evaluated cells give no row."""
    d = F.col("pred") - F.col("ref")
    return evaluated_pairs(px, cap80, mask_ref).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"),
        F.avg(d).alias("me"), _r2("pred", "ref").alias("r2"))


def chip_summary(chips: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Medians over chips of rmse, mae, me and r2 (chips without r2 ignored), the mean rmse, and the pixels and mean
    error of all chips together. The chip table is written first: it is tiny beside the pixels it comes from."""
    n = F.sum("n")
    return group_quantiles(stash(chips, "chips"), list(keys), {
        "rmse_median": ("rmse", 0.5), "mae_median": ("mae", 0.5), "me_median": ("me", 0.5),
        "r2_median": ("r2", 0.5)}, [F.count(F.lit(1)).alias("n_chips"), F.avg("rmse").alias("rmse_mean"),
                                    n.alias("n_px"), (F.sum(F.col("n") * F.col("me")) / n).alias("me_pooled")])


def zonal_statistics(layers: DataFrame, mask: DataFrame, aggregates: list[Column] = ()) -> DataFrame:
    """Per layer inside the mask: n_px, mean, p10 / p50 / p90 of every pixel with a value, and further constant-size
    aggregates. layers: (layer, r, c, v, ...); mask: (r, c). The pixels inside are joined and written once; sizes, sums
    and percentiles read that table."""
    # a semi join needs no distinct mask
    px = stash(layers.join(mask.select("r", "c"), ["r", "c"], "left_semi").where("v IS NOT NULL").drop("r", "c"), "zonal")
    return group_quantiles(px, ["layer"], {"p10": ("v", 0.1), "p50": ("v", 0.5), "p90": ("v", 0.9)},
                           [F.count(F.lit(1)).alias("n_px"), F.avg("v").alias("mean"), *aggregates])


def chip_keep(reference: DataFrame, min_share: float = MIN_SHARE, tile: int = CELL_PX) -> DataFrame:
    """(cr, cc, n1, kept): chips with reference cells above 1 m; kept when they are at least `min_share` of the full
    chip area (ragged chips too). Chips without any are left out."""
    return (reference.groupBy(F.floor(F.col("r") / tile).alias("cr"), F.floor(F.col("c") / tile).alias("cc"))
            .agg(F.count_if(F.col("v") > 1).alias("n1")).where("n1 > 0")
            .withColumn("kept", F.col("n1") / float(tile * tile) >= min_share))


def label_counts(labels: DataFrame, min_chips: int = 5, min_labels: int = 1000) -> DataFrame:
    """(chips, labels, ok): chips and positive labels of a stack and whether they suffice for training."""
    per = labels.groupBy("chip").agg(F.count_if(F.col("label") > 0).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("chips"), F.coalesce(F.sum("n"), F.lit(0)).alias("labels")).withColumn(
        "ok", (F.col("chips") >= min_chips) & (F.col("labels") >= min_labels))


def require_labels(labels: DataFrame, min_chips: int = 5, min_labels: int = 1000) -> DataFrame:
    """label_counts that fails when there is too little to train on."""
    text = F.format_string("%d chips and %d labels: at least %d and %d are needed", "chips", "labels",
                           F.lit(min_chips), F.lit(min_labels))
    return label_counts(labels, min_chips, min_labels).withColumn(
        "ok", F.when(F.col("ok"), F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))


def over_cap(labels: DataFrame, label: str = "label", cap: float = LABEL_CAP) -> DataFrame:
    """(kept, over): labels within (0, cap] and the number above the cap."""
    v = F.col(label)
    return labels.agg(F.count_if((v > 0) & (v <= cap)).alias("kept"), F.count_if(v > cap).alias("over"))


def scale_report(px: DataFrame, value: str = "v", minimum: float = 40.0) -> DataFrame:
    """Report colour scale: 0 .. max(40, p99 of the pooled values)."""
    return group_quantiles(px, [], {"p99": (value, 0.99)}).select(
        F.greatest(F.lit(minimum), F.coalesce("p99", F.lit(0.0))).alias("vmax"))


def scale_display(px: DataFrame, value: str = "v", step: float = 5.0) -> DataFrame:
    """Display colour scale: the largest p99.5 of the layers, rounded up to 5 m."""
    per = group_quantiles(px, ["layer"], {"q": (value, 0.995)})
    return per.agg(F.greatest(F.lit(step), F.ceil(F.coalesce(F.max("q"), F.lit(step)) / step) * step).alias("vmax"))


def scale_range(px: DataFrame, value: str = "v") -> DataFrame:
    """Comparison colour scale: p2 .. p98 of the pooled pixels rounded outwards, at least 1 m wide, not below 0."""
    out = group_quantiles(px, [], {"lo": (value, 0.02), "hi": (value, 0.98)})
    lo = F.greatest(F.lit(0.0), F.floor("lo").cast("double"))
    return out.select(lo.alias("vmin"), F.greatest(F.ceil("hi").cast("double"), lo + 1.0).alias("vmax"))


def crop_box(px: DataFrame) -> DataFrame:
    """Per layer: bounding box of the pixels with values, their mean and median."""
    return group_quantiles(px.where("v IS NOT NULL"), ["layer"], {"median": ("v", 0.5)}, [
        F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"),
        F.avg("v").alias("mean")])


def channel_statistics(x: DataFrame, column: str = "bands") -> DataFrame:
    """Mean and deviation of every band, zeros (no data) excluded."""
    return (x.select(F.posexplode(column).alias("band", "v")).where("v <> 0").groupBy("band")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")))


def charbonnier(pairs: DataFrame, eps: float = 1e-9, pred: str = "pred", ref: str = "ref",
                keys: list[str] = ()) -> DataFrame:
    """Mean smooth absolute difference over the pixels with a reference."""
    d = F.col(pred) - F.col(ref)
    return pairs.where(F.col(ref).isNotNull()).groupBy(*keys).agg(F.avg(F.sqrt(d * d + eps * eps)).alias("loss"))


def pooled_loss(px: DataFrame, k: int, size: int, keys: list[str] = ("chip",)) -> DataFrame:
    """Charbonnier loss after k x k average pooling; blocks that do not fit whole are dropped."""
    full = size // k
    blocks = (px.withColumn("br", F.floor(F.col("r") / k)).withColumn("bc", F.floor(F.col("c") / k))
              .where((F.col("br") < full) & (F.col("bc") < full)))
    pooled = blocks.groupBy(*keys, "br", "bc").agg(F.avg("pred").alias("pred"), F.avg("ref").alias("ref"))
    return charbonnier(pooled)


def area_km2(mask: DataFrame, res: float = 10.0) -> DataFrame:
    n = F.count(F.lit(1))
    return mask.select("r", "c").distinct().agg(n.alias("px"), (n * res * res / 1e6).alias("area_km2"))
