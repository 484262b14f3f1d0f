"""Planar overlay of polygons as equality joins on grid cells: exact overlap areas, union, validity repair.

Edges go to the cells of a grid that they pass. Edges that meet in a cell cut each other, so afterwards the pieces touch
at their ends only and every piece has one state on either side: the set of polygons (even-odd, so self-crossing rings are
repaired) that hold the ground there. The state beside a piece is the parity of the polygon's edges on a path from far
above: down the left side of the cell column (toggles per column, summed once), along the upper side of the cell and
down to the piece, both inside the cell. Any region defined by these sets, such as an intersection or a union, is
bounded by the pieces whose two sides differ, and its area is a sum over them.

No edge is paired with an edge of another cell. The grid lines lie at an odd fraction of the cell size, away from
coordinates that data commonly have. Cells should hold few edges: cell_size gives twice the mean edge.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stash

SHIFT = 0.3819660112501051          # of the grid lines, in cells
TOLERANCE = 1e-9                    # of equal places, in cells
BESIDE = 1e-6                       # distance of a side's test point from its piece, in cells
BAND = 32                           # rows of cells in which runs of inner cells are looked up


def cell_size(edges: DataFrame) -> float:
    """Twice the mean edge length."""
    return 2 * (edges.agg(F.avg(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))).first()[0] or 1.0)


def _at(v: Column, m: float) -> Column:
    return F.floor(v / m - SHIFT)


def _line(i: Column, m: float) -> Column:
    """Coordinate of the lower grid line of the cells numbered i."""
    return (i + SHIFT) * m


def _y_at(x: Column) -> Column:
    return F.col("y1") + (x - F.col("x1")) * (F.col("y2") - F.col("y1")) / F.nullif(F.col("x2") - F.col("x1"), F.lit(0.0))


def _listed(edges: DataFrame, m: float) -> DataFrame:
    """Every edge once per cell (col, row) that it passes or touches."""
    pad = TOLERANCE * m
    low, high = F.least("x1", "x2"), F.greatest("x1", "x2")
    cols = edges.withColumn("col", F.explode(F.sequence(_at(low - pad, m), _at(high + pad, m))))
    left, right = _line(F.col("col"), m), _line(F.col("col") + 1, m)
    upright = F.col("x1") == F.col("x2")
    ya = F.when(upright, F.col("y1")).otherwise(_y_at(F.least(F.greatest(low, left), high)))
    yb = F.when(upright, F.col("y2")).otherwise(_y_at(F.least(F.greatest(low, right), high)))
    bounded = cols.withColumn("_a", F.least(ya, yb) - pad).withColumn("_b", F.greatest(ya, yb) + pad)
    return bounded.withColumn("row", F.explode(F.sequence(_at(F.col("_a"), m), _at(F.col("_b"), m)))).drop("_a", "_b")


def _cuts(listed: DataFrame, m: float) -> DataFrame:
    """(e, k, g, t, x, y, ex, ey): places inside an edge, t of its length, where another edge crosses or touches it. The
    two edges of a crossing are cut at the same coordinates, and a touching end cuts at its own."""
    names = ["e", "g", "x1", "y1", "x2", "y2"]
    a, b = (listed.select("k", "col", "row", *[F.col(n).alias(p + n) for n in names]) for p in "ab")
    pairs = a.join(b, ["k", "col", "row"]).where("ae < be").drop("col", "row")
    length = {p: F.hypot(F.col(f"{p}x2") - F.col(f"{p}x1"), F.col(f"{p}y2") - F.col(f"{p}y1")) for p in "ab"}
    step = {p: (F.col(f"{p}x2") - F.col(f"{p}x1"), F.col(f"{p}y2") - F.col(f"{p}y1")) for p in "ab"}
    det = step["a"][0] * step["b"][1] - step["a"][1] * step["b"][0]
    gx, gy = F.col("bx1") - F.col("ax1"), F.col("by1") - F.col("ay1")
    slanted = F.abs(det) > 1e-12 * length["a"] * length["b"]
    pairs = (pairs.withColumn("_s", slanted).withColumn("_la", length["a"]).withColumn("_lb", length["b"])
             .withColumn("_t", F.when(slanted, (gx * step["b"][1] - gy * step["b"][0]) / F.nullif(det, F.lit(0.0))))
             .withColumn("_u", F.when(slanted, (gx * step["a"][1] - gy * step["a"][0]) / F.nullif(det, F.lit(0.0)))))
    tol = TOLERANCE * m
    x, y = F.col("ax1") + F.col("_t") * step["a"][0], F.col("ay1") + F.col("_t") * step["a"][1]

    def crossing(own: str, mine: str, other: str, theirs: str) -> Column:
        near, far = tol / F.col(f"_l{own}"), tol / F.col(f"_l{other}")
        first, last = F.col(theirs) <= far, F.col(theirs) >= 1 - far
        inside = F.col("_s") & F.col(mine).between(near, 1 - near) & F.col(theirs).between(-far, 1 + far)
        return F.when(inside, _cut(own, F.col(mine), *[
            F.when(first, F.col(f"{other}{c}1")).when(last, F.col(f"{other}{c}2")).otherwise(v) for c, v in (("x", x), ("y", y))]))

    def touching(own: str, other: str, end: int) -> Column:
        px, py = F.col(f"{other}x{end}"), F.col(f"{other}y{end}")
        dx, dy = px - F.col(f"{own}x1"), py - F.col(f"{own}y1")
        size = F.col(f"_l{own}")
        t = (dx * step[own][0] + dy * step[own][1]) / (size * size)
        away = F.abs(dx * step[own][1] - dy * step[own][0]) / size
        return F.when(~F.col("_s") & (away <= tol) & t.between(tol / size, 1 - tol / size), _cut(own, t, px, py))

    def _cut(own: str, t: Column, px: Column, py: Column) -> Column:
        return F.struct(F.col(f"{own}e").alias("e"), "k", F.col(f"{own}g").alias("g"), t.alias("t"), px.alias("x"), py.alias("y"),
                        F.col(f"{own}x2").alias("ex"), F.col(f"{own}y2").alias("ey"))

    found = F.array_compact(F.array(crossing("a", "_t", "b", "_u"), crossing("b", "_u", "a", "_t"),
                                    *[touching(p, q, end) for p, q in ("ab", "ba") for end in (1, 2)]))
    return pairs.select(F.explode(found).alias("c")).select("c.*")


def pieces(edges: DataFrame, m: float) -> tuple[DataFrame, DataFrame]:
    """(s, k, g, ax, ay, bx, by, weight) of the edges cut at each other, and the edges by cell.

    edges: k (plane; planes do not see each other), g (polygon: rings of one g are taken even-odd), x1, y1, x2, y2.
    weight shares a piece among the copies that lie on it."""
    full = stash(edges.select("k", "g", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
                 .where("x1 <> x2 OR y1 <> y2").withColumn("e", F.monotonically_increasing_id()), "edges")
    listed = stash(_listed(full, m), "listed")
    starts = full.select("e", "k", "g", F.lit(0.0).alias("t"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("x2").alias("ex"), F.col("y2").alias("ey"))
    along = Window.partitionBy("e").orderBy("t", "x", "y")
    cut = (starts.unionByName(_cuts(listed, m)).distinct()
           .select("k", "g", F.col("x").alias("ax"), F.col("y").alias("ay"), F.coalesce(F.lead("x").over(along), F.col("ex")).alias("bx"),
                   F.coalesce(F.lead("y").over(along), F.col("ey")).alias("by")).where("ax <> bx OR ay <> by"))
    a, b = F.array("ax", "ay"), F.array("bx", "by")
    one = Window.partitionBy("k", "_lo", "_hi")
    weighed = (cut.withColumn("_lo", F.least(a, b)).withColumn("_hi", F.greatest(a, b))
               .withColumn("weight", 1.0 / F.count(F.lit(1)).over(one)).drop("_lo", "_hi"))
    return stash(weighed.withColumn("s", F.monotonically_increasing_id()), "pieces"), listed


def sides(cut: DataFrame, listed: DataFrame, m: float) -> DataFrame:
    """(s, g, left, right): the polygons g that hold the ground to the left or right of a piece (1 or 0)."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    off = BESIDE * m / F.hypot(dx, dy)
    beside = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), ((F.col("ax") + F.col("bx")) / 2 - sign * dy * off).alias("px"),
                                          ((F.col("ay") + F.col("by")) / 2 + sign * dx * off).alias("py")) for i, sign in ((0, 1), (1, -1))]))
    points = (cut.select("s", "k", beside.alias("p")).select("s", "k", "p.*")
              .withColumn("col", _at(F.col("px"), m)).withColumn("row", _at(F.col("py"), m)))
    # inside the cell: along its upper side to the point's column, then down
    corner, top = _line(F.col("col"), m), _line(F.col("row") + 1, m)
    px, py = F.col("px"), F.col("py")
    y = _y_at(px)
    down = ((F.col("x1") <= px) != (F.col("x2") <= px)) & (y > py) & (y <= top)
    x = F.col("x1") + (top - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    along = ((F.col("y1") <= top) != (F.col("y2") <= top)) & (x > corner) & (x <= px)
    crossed = F.when(down, 1).otherwise(0) + F.when(along, 1).otherwise(0)
    local = (points.join(listed.select("k", "col", "row", "g", "x1", "y1", "x2", "y2"), ["k", "col", "row"])
             .select("s", "side", "g", crossed.alias("n")).where("n > 0"))
    # the corner of the cell: edges that cross the left side of its column above it
    edges = listed.select("k", "g", "x1", "y1", "x2", "y2", "e").dropDuplicates(["e"])
    low, high = F.least("x1", "x2"), F.greatest("x1", "x2")
    first, last = F.ceil(low / m - SHIFT), F.ceil(high / m - SHIFT) - 1
    lines = edges.where(first <= last).withColumn("col", F.explode(F.sequence(first, last)))
    toggles = (lines.withColumn("row", _at(_y_at(_line(F.col("col"), m)), m)).groupBy("k", "g", "col", "row")
               .agg((F.count(F.lit(1)) % 2).alias("odd")).where("odd = 1"))
    upwards = Window.partitionBy("k", "g", "col").orderBy(F.col("row").desc())
    runs = (toggles.withColumn("_i", F.row_number().over(upwards)).withColumn("a", F.lead("row").over(upwards))
            .where("_i % 2 = 1 AND a < row").select("k", "g", "col", "a", (F.col("row") - 1).alias("b")))
    banded = runs.withColumn("band", F.explode(F.sequence(F.floor(F.col("a") / BAND), F.floor(F.col("b") / BAND))))
    asked = points.select("k", "col", "row").distinct().withColumn("band", F.floor(F.col("row") / BAND))
    covered = asked.join(banded, ["k", "col", "band"]).where(F.col("row").between(F.col("a"), F.col("b"))).select("k", "col", "row", "g")
    above = points.join(covered, ["k", "col", "row"]).select("s", "side", "g", F.lit(1).alias("n"))
    held = local.unionByName(above).groupBy("s", "side", "g").agg((F.sum("n") % 2).alias("odd")).where("odd = 1")
    return held.groupBy("s", "g").agg(F.max((F.col("side") == 0).cast("int")).alias("left"), F.max((F.col("side") == 1).cast("int")).alias("right"))


def _signed(left: Column, right: Column) -> Column:
    """What a piece adds to the area of a region that lies on one of its sides."""
    cross = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    return (left - right) * F.col("weight") * cross / 2


def union_edges(edges: DataFrame, m: float | None = None) -> DataFrame:
    """(k, x1, y1, x2, y2): the boundary of the union of all polygons of a plane, each piece once, with the area on its
    left. Overlapping, touching and self-crossing rings are resolved; holes come out as boundary too."""
    m = m or cell_size(edges)
    cut, listed = pieces(edges, m)
    state = sides(cut, listed, m).groupBy("s").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    turn = F.col("left") > F.col("right")
    border = cut.join(state.where("left <> right"), "s")
    ends = [F.when(turn, F.col(p)).otherwise(F.col(q)).alias(n) for p, q, n in (("ax", "bx", "x1"), ("ay", "by", "y1"), ("bx", "ax", "x2"), ("by", "ay", "y2"))]
    return border.select("k", *ends).distinct()


def union_area(edges: DataFrame, m: float | None = None) -> DataFrame:
    """(k, area) of the union of all polygons of a plane."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return union_edges(edges, m).groupBy("k").agg((F.sum(cross) / 2).alias("area"))


def overlaps(areas: DataFrame, parts: DataFrame, m: float | None = None) -> DataFrame:
    """(k, id, area, inside): area of every polygon `id` and of its part inside the union of the plane's `part` polygons.

    areas: k, id, x1, y1, x2, y2; parts: k, part, x1, y1, x2, y2. Rings of one id or part are taken even-odd."""
    xy, none = ["x1", "y1", "x2", "y2"], F.lit(None).cast("string")
    named = (areas.select("k", F.struct(F.col("id").cast("string").alias("id"), none.alias("part")).alias("g"), *xy)
             .unionByName(parts.select("k", F.struct(none.alias("id"), F.col("part").cast("string").alias("part")).alias("g"), *xy)))
    m = m or cell_size(named)
    cut, listed = pieces(named, m)
    at = stash(sides(cut, listed, m), "sides")
    within = at.where("g.part IS NOT NULL").groupBy("s").agg(F.max("left").alias("rl"), F.max("right").alias("rr"))
    own = (at.where("g.id IS NOT NULL").select("s", F.col("g.id").alias("_id"), "left", "right").join(within, "s", "left")
           .join(cut.select("s", "k", "ax", "ay", "bx", "by", "weight"), "s"))
    rl, rr = F.coalesce("rl", F.lit(0)), F.coalesce("rr", F.lit(0))
    sums = own.groupBy("k", "_id").agg(F.sum(_signed(F.col("left"), F.col("right"))).alias("area"),
                                       F.sum(_signed(F.col("left") * rl, F.col("right") * rr)).alias("inside"))
    return sums.select("k", F.col("_id").cast(dict(areas.dtypes)["id"]).alias("id"), "area", "inside")


def region_shares(areas: DataFrame, region: DataFrame, m: float | None = None) -> DataFrame:
    """(id, area, inside, note): share of every study area (id, x1, y1, x2, y2) inside the union of the region's parts
    (part, x1, y1, x2, y2), by area, and what it means."""
    share = F.least(F.greatest(F.col("inside") / F.col("area"), F.lit(0.0)), F.lit(1.0))
    note = F.when(F.col("inside") < TOLERANCE, "outside").when(F.col("inside") < 0.999, "partial").otherwise("inside")
    plane = [F.lit(0).alias("k"), "x1", "y1", "x2", "y2"]
    both = overlaps(areas.select("id", *plane), region.select("part", *plane), m).drop("k").where("area > 0")
    return both.withColumn("inside", share).withColumn("note", note)
