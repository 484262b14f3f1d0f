"""Fine pixels aggregated to coarse blocks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geodesy import on_grid, resolution_m
from ..scale import group_quantiles, quantile_of_sorted, small
from ..schema import BUILT_UP, TREE, WATER
from ..session import stash
from .composite import first_source
from .resample import nearest

FINE_M, MAX_METRES = 2.0, 100.0        # fixed values: fine-reference limit, plausibility limit of heights in metres


def _block(c: str, f: int) -> Column:
    return F.floor(F.col(c) / f).cast("long")


def block_percentile(px: DataFrame, f: int, qs: dict[str, float], value: str = "v", keys: list[str] = ()) -> DataFrame:
    """Interpolated percentiles of f x f blocks, NULLs ignored, float32; a block without values is NULL.

    Pixels are unique, so a group holds at most f * f values."""
    agg = px.groupBy(*keys, _block("r", f).alias("r"), _block("c", f).alias("c")).agg(
        F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("_a"))
    return agg.select(*keys, "r", "c", *[quantile_of_sorted(F.col("_a"), q).cast("float").alias(n)
                                         for n, q in qs.items()])


def height_p90(px: DataFrame, factor: int = 10, nodata: int = 255) -> DataFrame:
    """90th percentile of factor x factor pixels with `nodata` missing."""
    return block_percentile(px.withColumn("v", F.nullif("v", F.lit(nodata))), factor, {"p90": 0.9})


def prepare_reference(fine: DataFrame, affine: Column, x0: float, y1: float, res: float, factor: int,
                      qs: dict[str, float], shape: tuple[int, int] | None = None) -> DataFrame:
    """Percentiles per grid pixel of fine rasters (source, prio, affine, r, c, v): nearest sampling onto the
    factor-times finer sub-grid, first source wins, then the block percentile."""
    fine_shape = None if shape is None else (shape[0] * factor, shape[1] * factor)
    sub = nearest(fine, affine, x0, y1, res / factor, keys=["prio"], shape=fine_shape)
    return block_percentile(first_source(sub, ["r", "c"], "v", "prio"), factor, qs)


def block_reduce(px: DataFrame, f: int, how: str = "mean", value: str = "v") -> DataFrame:
    """Block mean or maximum without missing values; blocks at the edge may be smaller."""
    fn = {"mean": F.avg, "max": F.max}[how]
    return px.groupBy(_block("r", f).alias("r"), _block("c", f).alias("c")).agg(fn(value).alias(value))


def display_average(px: DataFrame, f: int, value: str = "v", mask: str = "mask") -> DataFrame:
    """Block mean for display, missing where the majority of the mask is 0 (ties keep the block)."""
    ones = F.sum(F.when(F.col(mask) != 0, 1).otherwise(0))
    return px.groupBy(_block("r", f).alias("r"), _block("c", f).alias("c")).agg(
        F.when(2 * ones >= F.count(F.lit(1)), F.avg(value)).alias(value))


def landcover_shares(px: DataFrame, key: str = "cell", cls: str = "class") -> DataFrame:
    """Shares of water, built-up and tree pixels among the classified pixels; 0 without any."""
    n = F.count(cls)

    def share(k: int) -> Column:
        return F.coalesce(F.count_if(F.col(cls) == k) / F.nullif(n, F.lit(0)), F.lit(0.0))
    return px.groupBy(key).agg(share(WATER).alias("water"), share(BUILT_UP).alias("built"), share(TREE).alias("tree"))


def class_histogram(px: DataFrame, key: str = "cell", cls: str = "class") -> DataFrame:
    """Class counts per key as a map (one entry per land-cover class)."""
    counts = px.where(F.col(cls).isNotNull()).groupBy(key, cls).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(cls, "_n"))).alias("histogram"))


def histogram_share(histogram: Column, k: int) -> Column:
    """Share of a class in a histogram map, 0 when absent or empty."""
    total = F.aggregate(F.map_values(histogram), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.coalesce(F.try_element_at(histogram, F.lit(k)), F.lit(0)) / F.coalesce(F.nullif(total, F.lit(0)), F.lit(1))


def unit_check(px: DataFrame, value: str = "v") -> DataFrame:
    """(n, p99, ok): number of values and whether they look like metres (99th percentile at most 100)."""
    out = group_quantiles(px.where(F.col(value).isNotNull()), [], {"p99": (value, 0.99)},
                          [F.count(F.lit(1)).alias("n")])
    return out.select("n", "p99", (F.coalesce("p99", F.lit(0.0)) <= MAX_METRES).alias("ok"))


def height_reference(rasters: DataFrame, pixels: DataFrame, x0: float, y1: float, res: float = 10.0,
                     scale: float = 1.0, shape: tuple[int, int] | None = None) -> DataFrame:
    """Reference heights (r, c, v) on the grid from rasters (source, prio, affine, rx, ry, geographic, lat).

    Rasters of at most 2 m give the block p90, coarser ones the nearest value; a mix is an error, and so is a result
    that does not look like metres. First source wins.
    """
    sized = rasters.withColumn("res_m", resolution_m(F.col("rx"), F.col("ry"), F.col("geographic"), F.col("lat")))
    kinds = sized.agg(F.bool_and(F.col("res_m") <= FINE_M).alias("fine"),
                      F.bool_or(F.col("res_m") <= FINE_M).alias("some"),
                      F.min("res_m").alias("finest")).first()
    if kinds["fine"] is None:
        raise ValueError("no reference rasters")
    if kinds["fine"] != kinds["some"]:
        raise ValueError("reference rasters of mixed resolution: give only fine or only coarse ones")
    px = pixels.join(small(sized.select("source", "prio", "affine")), "source")
    if kinds["fine"]:
        factor = max(1, round(res / 1.0))
        out = prepare_reference(px, F.col("affine"), x0, y1, res, factor, {"v": 0.9}, shape)
    else:
        out = first_source(nearest(px, F.col("affine"), x0, y1, res, ["prio"], shape), ["r", "c"], "v", "prio")
    out = stash(out.select("r", "c", (F.col("v") * F.lit(scale)).alias("v")).where("v IS NOT NULL"), "reference")
    check = unit_check(out).first()
    if check["n"] and not check["ok"]:
        raise ValueError(f"reference heights do not look like metres (p99 {check['p99']:.4g})")
    return out


def off_grid(rasters: DataFrame, x0: float, y1: float) -> DataFrame:
    """Coarse rasters that are not on the analysis grid (their values shift by up to half a pixel)."""
    return rasters.where(~on_grid(F.col("same_crs"), F.col("affine")[0], F.col("affine")[4], F.col("affine")[2],
                                  F.col("affine")[5], F.lit(x0), F.lit(y1)))
