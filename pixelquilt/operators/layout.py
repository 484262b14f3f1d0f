"""Where the cells of a mosaic go, chips cut from rasters, halos and padding."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geodesy import grid_position
from ..scale import numbered, small
from ..schema import CELL_PX


def mosaic_layout(cells: DataFrame, grid: dict) -> DataFrame:
    """Cells inside the bounding box of the study-area cells with their position (mr, mc); the first cell in plan
    order keeps a position. Study-area cells off the grid are an error; without study-area cells it is empty."""
    pos = cells.withColumn("_p", grid_position(F.col("x0"), F.col("y1"), grid["x0"], grid["y1"]))
    aoi = pos.where(F.col("role") == "aoi")
    box = aoi.agg(F.struct(F.min("_p.row").alias("r0"), F.max("_p.row").alias("r1"), F.min("_p.col").alias("c0"),
                           F.max("_p.col").alias("c1"), F.count_if(F.col("_p").isNull()).alias("off")).alias("box"))
    b = F.col("_b")
    boxed = pos.withColumn("_b", box.scalar())
    checked = boxed.withColumn("_p", F.when(b["off"] > 0, F.raise_error(F.lit("study-area cells off the grid"))
                                            .cast("struct<row:int,col:int>")).otherwise(F.col("_p")))
    inside = checked.where(F.col("_p.row").between(b["r0"], b["r1"]) & F.col("_p.col").between(b["c0"], b["c1"]))
    rest = [c for c in cells.columns]
    return (inside.select((F.col("_p.row") - b["r0"]).alias("mr"), (F.col("_p.col") - b["c0"]).alias("mc"),
                          F.struct(*rest).alias("_cell"))
            .groupBy("mr", "mc").agg(F.min_by("_cell", "_cell.ord").alias("_cell")).select("mr", "mc", "_cell.*"))


def place_cells(px: DataFrame, layout: DataFrame, size: int = CELL_PX) -> DataFrame:
    """Cell pixels at their mosaic row and column (gr, gc)."""
    return (px.join(small(layout.select("cell", "mr", "mc")), "cell")
            .withColumn("gr", F.col("mr") * size + F.col("r")).withColumn("gc", F.col("mc") * size + F.col("c")))


def chips_of(px: DataFrame, tile: int = 256) -> DataFrame:
    """Chip position (cr, cc) and the pixel's place inside it."""
    return (px.withColumn("cr", F.floor(F.col("r") / tile)).withColumn("cc", F.floor(F.col("c") / tile))
            .withColumn("pr", F.col("r") % tile).withColumn("pc", F.col("c") % tile))


def kept_chips(labels: DataFrame, tile: int = 256, min_labelled: int = 1) -> DataFrame:
    """Chips with enough labels, with the pixel row / column of their upper-left corner."""
    return (chips_of(labels, tile).groupBy("cr", "cc").agg(F.count("label").alias("n"))
            .where(F.col("n") >= min_labelled)
            .select("cr", "cc", (F.col("cr") * tile).alias("row"), (F.col("cc") * tile).alias("col"), "n"))


def _mirrors(i: Column, size: Column, pad: Column) -> Column:
    """Index and its mirror images beyond `size`: reflect (edge not repeated) when the pad is smaller than the
    size, otherwise symmetric. The mirror repeats until the pad is filled (size 1 included)."""
    reflect = F.array_compact(F.array(i, F.when((i < size - 1) & (2 * (size - 1) - i < size + pad),
                                                2 * (size - 1) - i)))
    target = F.sequence(F.lit(0).cast("long"), (size + pad - 1).cast("long"))
    symmetric = F.filter(target, lambda k: F.when(F.pmod(k, 2 * size) < size, F.pmod(k, 2 * size))
                         .otherwise(2 * size - 1 - F.pmod(k, 2 * size)) == i)
    return F.when(pad == 0, F.array(i)).when(pad < size, reflect).otherwise(symmetric)


def pad_tiles(px: DataFrame, height: int, width: int, tile: int, missing: str | None = None) -> DataFrame:
    """Raster (r, c, ...) padded at the bottom / right to a multiple of the tile by mirrored copies; the mode is
    reflect if both pads are smaller than their side, else symmetric. `missing` names a column (the label) that is
    NULL in the padding instead of mirrored."""
    ph, pw = -height % tile, -width % tile
    if ph == 0 and pw == 0:
        return px
    both = ph < height and pw < width
    h, w = F.lit(height).cast("long"), F.lit(width).cast("long")

    def images(i: Column, size: Column, pad: int) -> Column:
        if both or pad == 0:
            return _mirrors(i, size, F.lit(pad).cast("long"))
        n = F.sequence(F.lit(0).cast("long"), (size + pad - 1).cast("long"))
        return F.filter(n, lambda k: F.when(F.pmod(k, 2 * size) < size, F.pmod(k, 2 * size))
                        .otherwise(2 * size - 1 - F.pmod(k, 2 * size)) == i)
    r, c = F.col("r").cast("long"), F.col("c").cast("long")
    out = (px.withColumn("_r", F.explode(images(r, h, ph))).withColumn("_c", F.explode(images(c, w, pw))))
    if missing:
        inside = (F.col("_r") < height) & (F.col("_c") < width)
        out = out.withColumn(missing, F.when(inside, F.col(missing)))
    return out.withColumn("r", F.col("_r")).withColumn("c", F.col("_c")).drop("_r", "_c")


def tile_rasters(px: DataFrame, height: int, width: int, x0: float, y1: float, res: float = 10.0, tile: int = 256,
                 min_labelled: int = 1) -> tuple[DataFrame, DataFrame]:
    """Labelled chips of a raster (r, c, label, ...): (pixels, index).

    pixels: chip, pr, pc and the values; the raster is padded to whole chips, with mirrored values and NULL labels.
    index: chip (0 on, row by row), row, col of the upper-left pixel, its map corner x, y, and n labels. Chips with
    fewer than `min_labelled` labels are left out of both."""
    kept = numbered(kept_chips(px, tile, min_labelled), ["cr", "cc"], "chip")     # padding holds no label
    index = kept.withColumn("x", x0 + F.col("col") * res).withColumn("y", y1 - F.col("row") * res)
    placed = chips_of(pad_tiles(px, height, width, tile, missing="label"), tile)
    pixels = placed.join(small(index.select("cr", "cc", "chip")), ["cr", "cc"]).drop("cr", "cc", "r", "c")
    return pixels, index.select("chip", "row", "col", "x", "y", "n")


def halo_blocks(px: DataFrame, block: int, halo: int, height: int, width: int) -> DataFrame:
    """Every pixel once per block whose halo contains it: (br, bc) and whether it is in the block's core."""
    def reach(i: Column, size: int) -> Column:
        last = (size - 1) // block
        return F.sequence(F.greatest(F.floor((i - halo) / block), F.lit(0)).cast("long"),
                          F.least(F.floor((i + halo) / block), F.lit(last)).cast("long"))
    return (px.withColumn("br", F.explode(reach(F.col("r"), height)))
            .withColumn("bc", F.explode(reach(F.col("c"), width)))
            .withColumn("core", (F.floor(F.col("r") / block) == F.col("br"))
                        & (F.floor(F.col("c") / block) == F.col("bc"))))
