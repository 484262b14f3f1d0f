"""Raw radar scenes, each in its own UTM zone and affine, on the analysis grids of cells, and on to the composite.

The mapping is inverse: every pixel centre of a cell's grid (with its halo) is projected into the zone of each scene
that covers the cell and turned into a fractional source index. On the other side every source pixel carries the three
neighbours that bilinear resampling needs (right, lower, diagonal), found inside blocks that share one pixel with the
next block, so no source pixel goes to more blocks than its halo. One equality join on the upper-left source index then
gives bilinear (filter-set members) and nearest (acquisitions) at once: the nearest pixel is one of the four.

The chain to decibels runs inside blocks of the cells' grids. Scenes, grids and angles are dealt out by block before their
rows become pixels (by_blocks, focal.block_pixels), so all scenes of a block's pixels are in one task and pixels are not
shuffled: what meets on more than the block meets by a window over the union of both (_beside), since a join on more
keys than the block would shuffle both sides again. Pixels and angles that come without a block are dealt out once.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geodesy import fractional_index, pixel_centre, utm_forward, utm_inverse
from ..scale import small, spread
from ..schema import RES
from ..session import stash
from . import focal
from .focal import AT, _dealt, _listed, _neighbour, _own, block_pixels, in_blocks, terrain_geometry
from .radar import block_db, radar_composite

HALO = 10               # pixels around a cell: the box reaches 7, bilinear and terrain 1 each
REACH = 7               # of them, what a block of the grid shares with the next one
BANDS = ("vv", "vh")
PLACE = ["cell", *AT]   # a block of a cell's grid
TASK_PIXELS = 150_000   # most grid pixels of all scenes that one task gets, as far as blocks go


def grid_parts(pairs: DataFrame, n: int, halo: int = HALO) -> int:
    """Number of partitions for the blocks of the grids: by their pixels, because those do not show in the tables dealt out."""
    m = n + 2 * halo
    seen = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("cell").alias("cells")).first()
    blocks = seen["cells"] * math.ceil(m / max(focal.BLOCK, REACH)) ** 2
    return max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(blocks, math.ceil(seen["pairs"] * m * m / TASK_PIXELS)))


def by_blocks(df: DataFrame, n: int, halo: int, parts: int) -> DataFrame:
    """Rows with a cell, once per block of its grid, dealt out by block: to be done before they become pixels."""
    return in_blocks(df, n + 2 * halo, REACH).repartition(parts, *PLACE)


def _placed(df: DataFrame) -> list[str]:
    """The columns of the block, if the table was dealt out by block."""
    return PLACE if set(PLACE) <= set(df.columns) else []


def _beside(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
    """left with the rows of right that have its keys (the block among them) as an array of structs, empty without one."""
    known = right.dropna(subset=keys)                   # as in a join, NULL meets nothing
    value = F.struct(*[c for c in right.columns if c not in keys]).alias(name)
    both = left.withColumn("_left", F.lit(True)).unionByName(known.select(*keys, value), allowMissingColumns=True)
    return both.withColumn(name, F.collect_list(name).over(Window.partitionBy(*keys))).where("_left").drop("_left")


def framed(pixels: DataFrame, scenes: DataFrame) -> DataFrame:
    """Scene pixels and, around them, the places left of and above the first ones, without values: the upper-left
    index of a target just outside the scene. scenes: sid, height, width; by block if the pixels are, and then, if
    they have the source window of the block (_r0, _r1, _c0, _c1), only the places in it."""
    at, clipped = _placed(scenes), "_r0" in scenes.columns

    def upto(rows: DataFrame, first: int, size: str, along: str) -> DataFrame:
        begin, end = F.lit(first).cast("long"), F.col(size).cast("long") - 1
        if clipped:
            begin, end = F.greatest(begin, F.col(f"_{along}0")), F.least(end, F.col(f"_{along}1"))
        return rows.where(begin <= end).withColumn(along, F.explode(F.sequence(begin, end)))

    minus = F.lit(-1).cast("long")
    above, beside = (scenes.where("_r0 < 0"), scenes.where("_c0 < 0")) if clipped else (scenes, scenes)
    top = upto(above, -1, "width", "c").select("sid", *at, minus.alias("r"), "c")
    left = upto(beside, 0, "height", "r").select("sid", *at, "r", minus.alias("c"))
    return pixels.unionByName(top.unionByName(left), allowMissingColumns=True)


def quads(pixels: DataFrame, scenes: DataFrame, values: list[str]) -> DataFrame:
    """(sid, r, c, k): every pixel with its right, lower and diagonal neighbour as four structs of the values in k; a
    neighbour outside the scene is NULL. pixels: sid, r, c, values; dense over its scene (masked pixels included).
    Pixels and scenes that were dealt out by block of a grid stay there, and so do the quads."""
    place = _placed(pixels)
    at = framed(pixels.select("sid", *place, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"),
                              F.struct(*values).alias("p")), scenes)
    keys = ["sid", *place[:1]]
    right = (at if place else _dealt(at, keys, 1)).withColumn("p01", _neighbour("p", "c", [*keys, "r"], 1))
    both = (right.withColumn("p10", _neighbour("p", "r", [*keys, "c"], 1))
            .withColumn("p11", _neighbour("p01", "r", [*keys, "c"], 1)))
    return (both if place else _own(both)).select("sid", *place, "r", "c", F.array("p", "p01", "p10", "p11").alias("k"))


def target_pixels(cells: DataFrame, pairs: DataFrame, scenes: DataFrame, n: int, halo: int = HALO,
                  res: float = RES, parts: int | None = None, roles: DataFrame | None = None) -> DataFrame:
    """(sid, cell, r, c, x, y, epsg, u, w): pixels of the analysis grids, numbered from the halo's corner, with the
    fractional source column u and row w in every scene of the cell. parts: dealt out by block, with the block and _own;
    roles: with the columns of scene_roles and the geometry sx, sy, rot of the grid pixel.

    cells: cell, epsg, x0, y1 (corner of the cell without halo); pairs: sid, cell; scenes: sid, epsg, affine."""
    m = n + 2 * halo
    known = scenes.select("sid", F.col("epsg").cast("int").alias("_zone"), "affine")
    role = [] if roles is None else [c for c in roles.columns if c != "sid"]
    # the scenes of a cell travel with its rows, so the pixels of the grid meet no table
    seen = (pairs.join(known.join(roles, "sid", "left") if role else known, "sid")
            .groupBy("cell").agg(F.collect_list(F.struct("sid", "_zone", "affine", *role)).alias("_s")))
    if role:                                            # sets that no acquisition of the cell asks for need no sums there
        asked = F.transform("_s", lambda s: s["set"])
        seen = seen.withColumn("_s", F.transform("_s", lambda s: s.withField("sets", F.filter(s["sets"], lambda x: F.array_contains(asked, x)))))
    each = cells.select("cell", F.col("epsg").cast("int").alias("epsg"), "x0", "y1").join(seen, "cell")
    if parts is None:
        rows = each.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        grid, place = spread(rows, "cell", "r").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))), []
    else:
        grid, place = block_pixels(by_blocks(each, n, halo, parts), m, REACH), [*AT, "_own"]
    x = pixel_centre(F.col("x0") - halo * res, F.col("c"), res)
    y = pixel_centre(F.col("y1") + halo * res, F.col("r"), res, downwards=True)
    centres = grid.select("cell", *place, "epsg", "r", "c", x.alias("x"), y.alias("y"), "_s")
    if role:
        sx, sy, rot = terrain_geometry(F.col("x"), F.col("y"), F.col("epsg"), res)
        centres, place = centres.withColumns({"sx": sx, "sy": sy, "rot": rot}), [*place, "sx", "sy", "rot"]
    lon, lat = utm_inverse(F.col("x"), F.col("y"), F.col("epsg"))
    named = centres.withColumn("_lon", lon).withColumn("_lat", lat)            # once a pixel, not once a scene
    each = named.withColumn("_s", F.explode("_s")).select("cell", *place, "epsg", "r", "c", "x", "y", "_lon", "_lat", "_s.*")
    other = F.col("_zone") != F.col("epsg")
    fx, fy = utm_forward(F.col("_lon"), F.col("_lat"), F.col("_zone"))
    there = (each.withColumn("_x", F.when(other, fx).otherwise(F.col("x"))).withColumn("_y", F.when(other, fy).otherwise(F.col("y"))))
    u, w = fractional_index(F.col("affine"), F.col("_x"), F.col("_y"))
    return (there.withColumn("u", u).withColumn("w", w).select("sid", "cell", "r", "c", "x", "y", "epsg", "u", "w", *place, *role))


def on_targets(targets: DataFrame, quad: DataFrame) -> DataFrame:
    """Targets with their quad k; NULL outside the scene. Both sides have a row a pixel, however small the tables are that
    Spark derives their sizes from: neither may be broadcast. Quads that were dealt out by block meet targets that were."""
    place = _placed(quad)
    t = targets.withColumn("_sr", F.floor("w")).withColumn("_sc", F.floor("u"))
    q = quad.select("sid", *place, F.col("r").alias("_sr"), F.col("c").alias("_sc"), "k")
    if not place:
        return t.join(q.hint("merge"), ["sid", "_sr", "_sc"], "left").drop("_sr", "_sc")
    return _beside(t, q, ["sid", *place, "_sr", "_sc"], "_k").withColumn("_k", F.explode_outer("_k")).select(*targets.columns, "_k.k")


def _read_by_blocks(pixels: DataFrame, scenes: DataFrame, targets: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """(pixels, scenes) dealt out by block of the grids: pixels to the blocks whose targets read them, scenes with the
    source window (_r0, _r1, _c0, _c1) that a block reads. Windows are listed by the source blocks that they touch."""
    def first(v: str) -> Column:
        return F.floor(F.min(v)).cast("long")

    def last(v: str) -> Column:
        return F.floor(F.max(v)).cast("long") + 1

    def touched(along: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(f"_{along}0") / focal.BLOCK), F.floor(F.col(f"_{along}1") / focal.BLOCK)))

    bounds = stash(targets.groupBy("sid", *PLACE).agg(first("w").alias("_r0"), last("w").alias("_r1"), first("u").alias("_c0"), last("u").alias("_c1")), "windows")
    tiles = bounds.withColumn("_tr", touched("r")).withColumn("_tc", touched("c"))
    meets = (pixels.withColumn("_tr", F.floor(F.col("r") / focal.BLOCK)).withColumn("_tc", F.floor(F.col("c") / focal.BLOCK))
             .join(small(tiles), ["sid", "_tr", "_tc"])
             .where(F.col("r").between(F.col("_r0"), F.col("_r1")) & F.col("c").between(F.col("_c0"), F.col("_c1"))))
    return (meets.select(*pixels.columns, *PLACE).repartition(parts, *PLACE),
            bounds.join(scenes.select("sid", "height", "width"), "sid").repartition(parts, *PLACE))


def _shares() -> list[Column]:
    """Bilinear weights of the four pixels of a quad: a step along the columns, then one along the rows."""
    right, down = F.col("u") - F.floor("u"), F.col("w") - F.floor("w")
    return [across * along for along in (1 - down, down) for across in (1 - right, right)]


def bilinear_values(at: DataFrame, values: list[str], mask: str = "m", prefix: str = "", keep: list[str] = ()) -> DataFrame:
    """sid, cell, r, c, values, w: renormalised over the valid pixels of the quad, 0 without one; w is the weighted
    mask in 1/255 steps. prefix: of the values' names; keep: further columns that stay."""
    corner = [F.get("k", F.lit(i)) for i in range(4)]
    part = [F.coalesce(k[mask].cast("double"), F.lit(0.0)) for k in corner]
    share = [F.when(m > 0, s).otherwise(0.0) for m, s in zip(part, _shares())]
    weight = sum(share[1:], share[0])
    masked = [s * m for s, m in zip(_shares(), part)]
    out = [F.when(weight > 0, sum((F.when(m > 0, s * k[v]).otherwise(0.0) for k, m, s in zip(corner, part, share)), F.lit(0.0)) / weight)
           .otherwise(0.0).alias(prefix + v) for v in values]
    return at.select("sid", "cell", "r", "c", *keep, *out, (F.rint(sum(masked[1:], masked[0]) * 255.0) / 255.0).alias("w"))


def nearest_values(at: DataFrame, values: list[str], keep: list[str] = ()) -> DataFrame:
    """sid, cell, r, c, x, y, epsg, values of the source pixel nearest to the target centre (half to even); NULL outside.
    keep: further columns that stay."""
    place = 2 * (F.rint("w") - F.floor("w")) + (F.rint("u") - F.floor("u"))
    k = F.get("k", place.cast("int"))
    return at.select("sid", "cell", "r", "c", "x", "y", "epsg", *keep, *[k[v].alias(v) for v in values])


def scene_roles(acquisitions: DataFrame) -> DataFrame:
    """(sid, acq, set, sets) once per scene: its rows (t, heading) as an acquisition, the set that filters it (named by the
    first acquisition with the same members) and the sets that it is a member of."""
    rows = (acquisitions.where("id IS NOT NULL").groupBy(F.col("id").alias("sid"))
            .agg(F.collect_list(F.struct("t", "heading")).alias("acq"), F.array_sort(F.flatten(F.collect_list("members"))).alias("_m")))
    named = rows.join(rows.groupBy("_m").agg(F.min("sid").alias("set")), "_m")
    of = (named.where(F.col("sid") == F.col("set")).select("set", F.explode("_m").alias("sid"))
          .groupBy("sid").agg(F.collect_list("set").alias("sets")))
    return named.drop("_m").join(of, "sid", "full_outer")


def _block_decibels(pixels: DataFrame, scenes: DataFrame, acquisitions: DataFrame, cells: DataFrame, pairs: DataFrame,
                    angles: DataFrame, n: int, halo: int, res: float) -> DataFrame:
    """scene_decibels with the block of the pixel."""
    bands, m, parts = list(BANDS), n + 2 * halo, grid_parts(pairs, n, halo)
    values, geometry = [*bands, "m", "elev", "tv"], ["sx", "sy", "rot"]
    if _placed(pixels):
        frames = by_blocks(scenes.select("sid", "height", "width").join(pairs.select("sid", "cell").distinct(), "sid"), n, halo, parts)
    else:
        pixels, frames = _read_by_blocks(pixels, scenes, target_pixels(cells, pairs, scenes, n, halo, res, parts), parts)
    if not _placed(angles):
        within = [F.col(b).between(0, (m - 1) // max(focal.BLOCK, REACH)) for b in AT]
        angles = _listed(angles, REACH).where(within[0] & within[1]).repartition(parts, *PLACE)
    targets = target_pixels(cells, pairs, scenes, n, halo, res, parts, scene_roles(acquisitions))
    at = on_targets(targets, quads(pixels, frames, values))
    kept = [*AT, "_own", *geometry, "acq", "set", "sets"]
    taken = nearest_values(at, values, [*kept, "k", "u", "w"])
    both = bilinear_values(taken, bands, prefix="of_", keep=[*kept, *values])
    looked = _beside(both, angles.select("sid", *PLACE, "r", "c", "angle", "foot"), ["sid", *PLACE, "r", "c"], "_a")
    # a row for each angle and acquisition of the pixel; the scene is a member in the first one only, or in a row of its own
    each = (looked.select(*both.columns, F.posexplode_outer("_a").alias("_ia", "_a"))
            .select("*", F.posexplode_outer("acq").alias("_iq", "_q")))
    taken = F.col("_a").isNotNull() & F.col("_q").isNotNull()
    first = (F.coalesce("_ia", F.lit(0)) == 0) & (F.coalesce("_iq", F.lit(0)) == 0)
    px = each.select(F.col("sid").alias("id"), "cell", *AT, "_own", "r", "c", "_q.t", "_q.heading", *bands, F.coalesce("m", F.lit(0)).alias("m"), "_a.angle", "_a.foot",
                     F.when(taken, F.coalesce("elev", F.lit(0.0))).alias("elev"), F.coalesce("tv", F.lit(0)).alias("tv"), *geometry,
                     F.when(taken, F.col("set")).alias("set"), F.when(first, F.col("sets")).alias("sets"), *[f"of_{b}" for b in bands],
                     F.when(first, F.col("w")).alias("w"), taken.alias("_taken"), first.alias("_first"))
    db = block_db(px, ["id", "cell"], bands, sx=F.col("sx"), sy=F.col("sy"), rot=F.col("rot"), blocks=True, carriers=(F.col("_taken"), F.col("_first")))
    inside = F.col("r").between(halo, halo + n - 1) & F.col("c").between(halo, halo + n - 1)
    return db.where(inside).select(*PLACE, "id", "t", (F.col("r") - halo).alias("r"), (F.col("c") - halo).alias("c"), *bands)


def scene_decibels(pixels: DataFrame, scenes: DataFrame, acquisitions: DataFrame, cells: DataFrame, pairs: DataFrame,
                   angles: DataFrame, n: int, halo: int = HALO, res: float = RES) -> DataFrame:
    """(cell, id, t, r, c, vv, vh): flattened backscatter in dB of every acquisition on the pixels of its cells.

    pixels: sid, r, c, vv, vh, m (validity), elev, tv (terrain validity), dense over the scene's window
    scenes: sid, epsg, affine [a, b, c, d, e, f], height, width
    acquisitions: id, t, heading, members (scene ids; those without pixels in a cell contribute nothing there)
    cells: cell, epsg, x0, y1; pairs: sid, cell (scenes whose window meets the cell's grid)
    angles: sid, cell, r, c, angle, foot on the analysis grid with its halo

    Pixels and angles with the columns of a block (PLACE) are taken as dealt out by block (by_blocks with grid_parts; angles
    with the halo REACH), a pixel to every block of its scene's cells; otherwise each is shuffled once.
    """
    return (_block_decibels(pixels, scenes, acquisitions, cells, pairs, angles, n, halo, res)
            .select("cell", "id", "t", "r", "c", *BANDS))


def scene_composite(pixels: DataFrame, scenes: DataFrame, acquisitions: DataFrame, cells: DataFrame, pairs: DataFrame,
                    angles: DataFrame, n: int, halo: int = HALO, res: float = RES, seasonal: bool = False) -> DataFrame:
    """(cell, [season,] r, c, band, median, n) from raw scenes: see scene_decibels."""
    db = _block_decibels(pixels, scenes, acquisitions, cells, pairs, angles, n, halo, res)
    # a pixel of a cell has at most one value of each acquisition of the cell
    none = F.lit(0).cast("long")
    probe = (pairs.join(acquisitions.select(F.col("id").alias("sid")), "sid")
             .select("cell", *[none.alias(b) for b in AT], F.lit(0).alias("r"), F.lit(0).alias("c")))
    return radar_composite(db, PLACE, list(BANDS), seasonal, probe).drop(*AT)


__all__ = ["HALO", "REACH", "PLACE", "grid_parts", "by_blocks", "quads", "target_pixels", "on_targets", "bilinear_values", "nearest_values", "scene_roles",
           "scene_decibels", "scene_composite"]
