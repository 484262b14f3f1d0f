"""Temporal composites of observations."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.calendar import in_annual_window, in_seasonal_window, season_of
from ..functions.radiometry import good_quality
from ..scale import GROUP_ROWS, group_quantiles, small
from ..schema import BUILT_UP


def first_mask(masks: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One mask row per scene: the first in the given order (constant-size aggregate, so hot scenes are harmless)."""
    rest = [c for c in masks.columns if c != key]
    if len(order) == 1:                                # scalar buffers: a hash aggregate instead of a sorted one
        return masks.groupBy(key).agg(*[F.min_by(c, order[0]).alias(c) for c in rest])
    return (masks.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_m"))
            .select(key, *[F.col(f"_m.{c}") for c in rest]))


def join_masks(obs: DataFrame, masks: DataFrame, key: str = "sid", order: list[str] | None = None) -> DataFrame:
    """Observations with their scene's mask; scenes without a partner do not survive. The scene table is counted: up to
    SMALL_ROWS scenes it is broadcast, so the observations are shuffled only once, for the composite."""
    first = first_mask(masks, key, order) if order else masks
    return obs.join(small(first, masks.select(key)), key)


def median_composite(obs: DataFrame, keys: list[str], bands: list[str], scale: float = 1.0,
                     limit: int = GROUP_ROWS, probe: DataFrame | None = None,
                     probe_keys: list[str] | None = None) -> DataFrame:
    """Per-key median of every band; NULL observations are ignored. probe: unfiltered observations whose group
    sizes bound those of `obs`, so the size check reads two key columns instead of repeating the mask join."""
    out = group_quantiles(obs, keys, {b: (b, 0.5) for b in bands}, limit=limit, probe=probe, probe_keys=probe_keys)
    return out if scale == 1.0 else out.select(*keys, *[(F.col(b) / scale).alias(b) for b in bands])


def annual_optical(obs: DataFrame, year: int, keys: list[str], bands: list[str], valid: Column,
                   max_cloud: float = 40, max_prob: float = 20, probe: DataFrame | None = None) -> DataFrame:
    """Annual recipe: date window, scene cloud share, cloud probability and validity masks, median unscaled."""
    kept = obs.where(in_annual_window(F.col("t"), year) & (F.col("cloud") < max_cloud)
                     & (F.col("prob") < max_prob) & valid)
    return median_composite(kept, keys, bands, probe=probe)


def seasonal_optical(obs: DataFrame, year: int, keys: list[str], bands: list[str], valid: Column,
                     max_cloud: float = 50, scale: float = 10000.0, probe: DataFrame | None = None) -> DataFrame:
    """Four seasonal medians / 10000 of the window [Dec of the year before, Dec)."""
    kept = obs.where(in_seasonal_window(F.col("t"), year) & (F.col("cloud") < max_cloud)
                     & (F.col("prob") < max_cloud) & valid).withColumn("season", season_of(F.col("t")))
    return median_composite(kept, [*keys, "season"], bands, scale, probe=probe, probe_keys=keys)


def with_gaps(composite: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Composite on every pixel and season of the grid; what has no data is NULL, not absent."""
    seasons = grid.select(*keys).distinct().withColumn("season", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return seasons.join(composite, [*keys, "season"], "left")


def embedding_median(vectors: DataFrame, keys: list[str], column: str = "embedding") -> DataFrame:
    """Band-wise median of embedding vectors, bands kept in order (one array per key)."""
    long = vectors.select(*keys, F.posexplode(column).alias("band", "v"))
    medians = group_quantiles(long, [*keys, "band"], {"v": ("v", 0.5)})
    return medians.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("band", "v"))), lambda s: s["v"]).alias(column))


def label_median(obs: DataFrame, start: str, end: str, keys: list[str], value: str,
                 landcover: DataFrame | None = None) -> DataFrame:
    """Median label of the window [start, end) from good-quality shots; labels on built-up or unknown land cover
    (landcover: keys, class) are dropped."""
    t = F.col("t")
    kept = obs.where((t >= F.lit(start).cast("timestamp_ntz")) & (t < F.lit(end).cast("timestamp_ntz"))
                     & good_quality(F.col("quality"), F.col("degrade")))
    labels = group_quantiles(kept, keys, {"label": (value, 0.5)})
    return labels if landcover is None else drop_built_up(labels, landcover, keys)


def drop_built_up(labels: DataFrame, landcover: DataFrame, keys: list[str]) -> DataFrame:
    """NULL labels where the land cover is built-up; a missing class masks too."""
    return (labels.join(landcover.select(*keys, "class"), keys, "left")
            .withColumn("label", F.when(F.col("class") != BUILT_UP, F.col("label"))).drop("class"))


def counted_median(values: DataFrame, keys: list[str], value: str, limit: int = GROUP_ROWS,
                   probe: DataFrame | None = None, probe_keys: list[str] | None = None, probe_each: int = 1) -> DataFrame:
    """(keys, median, n): exact median and number of the values of a group of any size, NULLs ignored; a group without
    values gives no row. probe: a cheaper table whose counts by probe_keys (a subset of the keys), times probe_each, bound the sizes."""
    v = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    return group_quantiles(v, keys, {"median": ("_v", 0.5)}, [F.count(F.lit(1)).alias("n")], limit, probe, probe_keys, probe_each)


def acquisition_counts(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Acquisitions per key and season, and how many of them have data there."""
    per = obs.groupBy(*keys, season_of(F.col("t")).alias("season"), "sid").agg(
        F.max(F.col("v").isNotNull().cast("long")).alias("_data"))
    return per.groupBy(*keys, "season").agg(F.count(F.lit(1)).alias("acquisitions"), F.sum("_data").alias("with_data"))


def set_sums(obs: DataFrame, keys: list[str], value: str, mask: str) -> DataFrame:
    """Mask-weighted sum of the values and number of members with a mask above 0."""
    return obs.groupBy(*keys).agg(F.sum(F.col(value) * F.col(mask)).alias("isum"),
                                  F.count_if(F.col(mask) > 0).alias("cnt"))


def first_source(px: DataFrame, keys: list[str], value: str, priority: str) -> DataFrame:
    """Overlay: the first source (lowest priority number) with a value wins."""
    return px.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, priority).alias(value))


def last_on_top(px: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Mosaic: the last image with a value is on top."""
    return px.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, order).alias(value))
