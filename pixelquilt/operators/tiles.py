"""Tiled scoring with blended overlaps."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .layout import halo_blocks

TILE, OVERLAP, BLOCK, HALO = 256, 32, 2048, 256      # fixed values: default tile layout


def tile_origins(size: int, tile: int = TILE, overlap: int = OVERLAP) -> list[int]:
    """Tile starts along one axis: every tile - overlap pixels, the last one flush with the end."""
    if size <= tile:
        return [0]
    last = size - tile
    return sorted({*range(0, last + 1, tile - overlap), last})


def covering(i: Column, size: int, tile: int = TILE, overlap: int = OVERLAP) -> Column:
    """ARRAY of the tile starts whose tile contains index i, by arithmetic (no list of all tiles is scanned)."""
    if size <= tile:
        return F.array(F.lit(0).cast("long"))
    stride, last = tile - overlap, size - tile
    k0 = F.greatest(F.ceil((i - tile + 1) / stride), F.lit(0)).cast("long")
    k1 = F.least(F.floor(i / stride), F.lit(last // stride)).cast("long")
    regular = F.when(k0 <= k1, F.transform(F.sequence(k0, F.greatest(k0, k1)), lambda k: k * stride)) \
        .otherwise(F.array().cast("array<bigint>"))
    flush = F.when(i >= last, F.array(F.lit(last).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.concat(regular, flush))


def blend_weight(i: Column, tile: int = TILE, overlap: int = OVERLAP) -> Column:
    """1 in the centre of a tile, a linear ramp over `overlap` pixels at its edges."""
    if overlap <= 0:
        return F.lit(1.0)
    return F.least(F.lit(1.0), F.least(i + 1, tile - i) / (overlap + 1.0))


def to_tiles(px: DataFrame, height: int, width: int, tile: int = TILE, overlap: int = OVERLAP) -> DataFrame:
    """Every pixel once per tile that covers it, with the tile start (tr, tc) and its blend weight w."""
    out = (px.withColumn("tr", F.explode(covering(F.col("r"), height, tile, overlap)))
           .withColumn("tc", F.explode(covering(F.col("c"), width, tile, overlap))))
    return out.withColumn("w", blend_weight(F.col("r") - F.col("tr"), tile, overlap)
                          * blend_weight(F.col("c") - F.col("tc"), tile, overlap))


def blend(scored: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Weighted mean of the tile predictions (p, w) of every pixel; NULL where all inputs were 0 (empty)."""
    agg = scored.groupBy(*keys, "r", "c").agg((F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias("p"),
                                              F.bool_and("empty").alias("empty"))
    return agg.select(*keys, "r", "c", F.when(~F.col("empty"), F.col("p")).alias("p"))


def predict_tiles(px: DataFrame, score: Callable[[DataFrame], DataFrame], height: int, width: int,
                  tile: int = TILE, overlap: int = OVERLAP, bands: str = "bands") -> DataFrame:
    """Tiled prediction: pixels (r, c, bands) -> p. `score` maps the tiled pixels to the same rows with a column p
    (a column expression, or tile_scorer for a model that needs the whole tile)."""
    tiled = to_tiles(px.withColumn("empty", F.forall(bands, lambda b: b == 0)), height, width, tile, overlap)
    return blend(score(tiled))


def tile_scorer(predict: Callable[[pd.DataFrame], pd.Series], keys: list[str] = ("tr", "tc")):
    """Wrap a Python model: `predict` gets the pixels of one tile (at most tile x tile rows) sorted by r, c."""
    def score(tiled: DataFrame) -> DataFrame:
        schema = tiled.schema.simpleString()[len("struct<"):-1] + ",p:double"

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["r", "c"], ignore_index=True)
            return pdf.assign(p=predict(pdf))
        return tiled.groupBy(*keys).applyInPandas(run, schema)
    return score


def predict_blocks(px: DataFrame, mask: DataFrame, score: Callable[[DataFrame], DataFrame], height: int, width: int,
                   block: int = BLOCK, halo: int = HALO, tile: int = TILE, overlap: int = OVERLAP,
                   bands: str = "bands") -> DataFrame:
    """Prediction block by block with a halo of context; blocks without mask pixels are skipped, only the core of a
    block is kept. A raster that fits one block and its halos is tiled as a whole."""
    if height <= block + 2 * halo and width <= block + 2 * halo:
        return predict_tiles(px, score, height, width, tile, overlap, bands)
    wanted = mask.select(F.floor(F.col("r") / block).alias("br"), F.floor(F.col("c") / block).alias("bc")).distinct()
    haloed = halo_blocks(px, block, halo, height, width).join(wanted, ["br", "bc"], "left_semi")
    r0 = F.greatest(F.col("br") * block - halo, F.lit(0))
    c0 = F.greatest(F.col("bc") * block - halo, F.lit(0))
    h = F.least((F.col("br") + 1) * block + halo, F.lit(height)) - r0
    w = F.least((F.col("bc") + 1) * block + halo, F.lit(width)) - c0

    def starts(i: Column, size: Column) -> Column:
        """Tile starts covering local index i of a block whose size is a column."""
        stride, last = tile - overlap, size - tile
        k0 = F.greatest(F.ceil((i - tile + 1) / stride), F.lit(0)).cast("long")
        k1 = F.least(F.floor(i / stride), F.floor(last / stride)).cast("long")
        regular = F.when(k0 <= k1, F.transform(F.sequence(k0, F.greatest(k0, k1)), lambda k: k * stride)) \
            .otherwise(F.array().cast("array<bigint>"))
        flush = F.when(i >= last, F.array(last.cast("long"))).otherwise(F.array().cast("array<bigint>"))
        return F.when(size <= tile, F.array(F.lit(0).cast("long"))).otherwise(
            F.array_distinct(F.concat(regular, flush)))
    local = (haloed.withColumn("_lr", F.col("r") - r0).withColumn("_lc", F.col("c") - c0)
             .withColumn("_h", h).withColumn("_w", w)
             .withColumn("tr", F.explode(starts(F.col("_lr"), F.col("_h"))))
             .withColumn("tc", F.explode(starts(F.col("_lc"), F.col("_w"))))
             .withColumn("w", blend_weight(F.col("_lr") - F.col("tr"), tile, overlap)
                         * blend_weight(F.col("_lc") - F.col("tc"), tile, overlap))
             .withColumn("tr", F.col("tr") + r0).withColumn("tc", F.col("tc") + c0)
             .withColumn("empty", F.forall(bands, lambda b: b == 0)).drop("_lr", "_lc", "_h", "_w"))
    return blend(score(local).where("core"), ["br", "bc"]).drop("br", "bc")


def score_chips(chips: DataFrame, predict: Callable[[pd.DataFrame], pd.Series], chip: str = "chip",
                batch: int = 4) -> DataFrame:
    """Batch scoring of whole chips: rows (chip, r, c, bands) are brought together by chip and handed to the model
    `batch` chips at a time; the output keeps chip and pixel."""
    fields = f"{chip} bigint, r bigint, c bigint, p double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, ids = [], []

        def flush() -> pd.DataFrame:
            pdf = pd.concat(held, ignore_index=True)
            held.clear()
            ids.clear()
            return pd.DataFrame({chip: pdf[chip], "r": pdf["r"], "c": pdf["c"], "p": predict(pdf)})
        for frame in frames:
            for value, part in frame.groupby(chip, sort=False):
                if value not in ids and len(ids) == batch:
                    yield flush()
                if value not in ids:
                    ids.append(value)
                held.append(part)
        if held:
            yield flush()
    return chips.repartition(chip).sortWithinPartitions(chip, "r", "c").mapInPandas(run, fields)
