"""Shards by a k-d tree over the metadata of documents, split at weighted medians until leaves reach a size.

A node is cut along the dimension in which its box is widest (every dimension scaled to the box of all rows), where
the bytes on the left come nearest to the left leaves' share: half of them for a power of two. Rows that agree in that
dimension are told apart by the other dimensions, then by a hash of the text, then by the id, so every row has its own
place and no group of ties, however large, keeps a cut from being even. Equal texts whose metadata agree stand next to
each other in such an order: no more of these groups are divided than there are cuts.

A weighted median needs no sort. The bytes are summed over value ranges of the node, the range that holds the median
is cut again, and so on down to one row; a range of one value goes on with the next key. Each step is one aggregation
with map-side sums over a narrow table that was written once, for all nodes of a level together, and returns at most
LEVEL_BINS rows (LEAST_BINS a node, if that is more). The cuts of a level are one array inside a column expression.

Slots number the rows of a shard by id without a gap, from one range-partitioned sort of all shards.

Defined results: NULL and empty texts have size 1; a NULL in a dimension or id counts as -1; repeated rows are told
apart by their place in the written table; no rows give no rows; with fewer rows than shards some shards stay empty;
`write_shards` keeps the other columns, but for one called shard or slot.
"""
from __future__ import annotations

import json
import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row, functions as F

from ..scale import numbered
from ..session import stash

SHARDS = 8
DIMENSIONS = ("lang", "n_chars")      # not the source: copies of a text come from several sources and would be parted
LEVEL_BINS = 1 << 13                  # value ranges that all nodes of a level are counted over in one step
LEAST_BINS = 16                       # value ranges of a node, when a level has many nodes
OTHER_KEYS = 3                        # hash of the text, id, place of the row
DEPTH = 4                             # levels of cuts in one expression, before the node numbers are written again

_STEP = "array<struct<key:int,low:array<double>,high:array<double>>>"
_LEVEL = "array<struct<first:int,order:array<int>,cut:array<double>,inclusive:boolean>>"


def _coordinate(c: Column, kind: str) -> Column:
    """A number in the order of the values: of a string, its first six bytes."""
    if kind == "string":
        c = F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0"), 16, 10)
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(-1.0)), F.lit(-1.0))


def with_keys(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """docs + size, _crc and the keys _k: the dimensions, a hash of the text, the id and the place of the row."""
    kinds = dict(docs.dtypes)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.withColumns({
        "_size": (F.length(raw) + 1).cast("long"), "_crc": F.crc32(raw),
        "_k": F.array(*[_coordinate(F.col(f"`{d}`"), kinds[d]) for d in dimensions],
                      F.conv(F.substring(F.md5(raw), 1, 12), 16, 10).cast("double"), _coordinate(F.col("doc_id"), kinds["doc_id"]),
                      F.monotonically_increasing_id().cast("double"))})


class _Node:
    """A node of the tree and, while it is cut, the range of rows that holds the cut."""

    def __init__(self, leaves: int, stats: Row | None):
        self.leaves, self.left = leaves, leaves // 2
        self.stats, self.bytes, self.before = stats, stats["bytes"] if stats else 0, 0
        self.order: list[int] = []
        self.cut: list[float] | None = None
        self.inclusive = False

    def start(self, scale: list[float]) -> None:
        """Order of the keys: dimensions from the widest on, then the others."""
        low, high = self.stats["low"], self.stats["high"]
        wide = sorted(range(len(scale)), key=lambda i: (-(high[i] - low[i]) / scale[i], i))
        self.order = [*wide, *range(len(scale), len(low))]
        self._enter(self.stats)

    def _enter(self, part: Row) -> None:
        """Go on inside `part`, a range of the order; ready when it is one row."""
        self.low, self.high = list(part["low"]), list(part["high"])
        open_ = [k for k in self.order if self.low[k] < self.high[k]]
        self.key = open_[0] if open_ else None
        if self.key is None:
            self.cut = [self.low[k] for k in self.order]
            self.inclusive = (2 * self.before + part["bytes"]) * self.leaves <= 2 * self.bytes * self.left

    def narrow(self, parts: list[Row]) -> None:
        """Enter the first of the ordered parts that ends beyond the wanted share."""
        for part in parts:
            if (self.before + part["bytes"]) * self.leaves > self.bytes * self.left:
                return self._enter(part)
            self.before += part["bytes"]
        raise AssertionError("the parts of a node hold all its bytes")

    @property
    def searching(self) -> bool:
        return self.cut is None and self.leaves > 1 and self.bytes > 0


def _box(keys: int) -> list[Column]:
    at = [F.get("_k", F.lit(i)) for i in range(keys)]
    return [F.sum("_size").alias("bytes"), F.array(*map(F.min, at)).alias("low"), F.array(*map(F.max, at)).alias("high")]


def _cut_level(table: DataFrame, nodes: list[_Node], scale: list[float], keys: int) -> None:
    """Find the cuts of all nodes of a level, a step for all of them at a time."""
    for node in nodes:
        if node.searching:
            node.start(scale)
    bins = max(LEAST_BINS, LEVEL_BINS // len(nodes))
    while any(n.searching for n in nodes):
        steps = [{"key": n.key, "low": n.low, "high": n.high} if n.searching else None for n in nodes]
        step = F.get(F.from_json(F.lit(json.dumps(steps)), _STEP), F.col("_node"))
        at = F.get("_k", F.col("_s.key"))
        low, high = F.get("_s.low", F.col("_s.key")), F.get("_s.high", F.col("_s.key"))
        inside = reduce(and_, (F.get("_k", F.lit(i)).between(F.get("_s.low", F.lit(i)), F.get("_s.high", F.lit(i)))
                               for i in range(keys)))
        found = (table.withColumn("_s", step).where(F.col("_s").isNotNull() & inside)
                 .groupBy("_node", F.least(F.floor((at - low) / (high - low) * bins), F.lit(bins - 1)).alias("_bin"))
                 .agg(*_box(keys)).collect())                   # LEVEL_BINS rows at most
        parts: dict[int, list[Row]] = {}
        for r in sorted(found, key=lambda r: (r["_node"], r["_bin"])):
            parts.setdefault(r["_node"], []).append(r)
        for i, rows in parts.items():
            nodes[i].narrow(rows)


def _sides(node: Column, level: list[dict | None]) -> Column:
    """Numbers of the nodes one level further down."""
    s = F.get(F.from_json(F.lit(json.dumps(level)), _LEVEL), node)
    place = F.transform(s["order"], lambda i: F.get("_k", i))
    right = (place > s["cut"]) | ((place == s["cut"]) & ~s["inclusive"])      # arrays compare key by key
    return s["first"] + F.coalesce(right.cast("int"), F.lit(0))


def tree(table: DataFrame, dimensions: int, shards: int) -> list[list[dict]]:
    """The levels of the k-d tree with `shards` leaves over table(_size, _k), which should be a written one."""
    levels: list[list[dict]] = []
    at, leaves, keys = table.select("_size", "_k", F.lit(0).alias("_node")), [shards], dimensions + OTHER_KEYS
    scale: list[float] = []
    while max(leaves) > 1:
        rows = {r["_node"]: r for r in at.groupBy("_node").agg(*_box(keys)).collect()}        # a row a node
        if not scale and rows:
            scale = [(rows[0]["high"][i] - rows[0]["low"][i]) or math.inf for i in range(dimensions)]
        nodes = [_Node(n, rows.get(i)) for i, n in enumerate(leaves)]
        _cut_level(at, nodes, scale, keys)
        level, leaves = [], []
        for n in nodes:
            level.append({"first": len(leaves), "order": n.order, "cut": n.cut, "inclusive": n.inclusive})
            leaves += [1] if n.leaves == 1 else [n.left, n.leaves - n.left]
        levels.append(level)
        at = at.withColumn("_node", _sides(F.col("_node"), level))
        if len(levels) % DEPTH == 0 and max(leaves) > 1:
            at = stash(at, "nodes")
    return levels


def placed(table: DataFrame, levels: list[list[dict]]) -> DataFrame:
    """table(_k, ...) + shard, the number of the leaf from left to right."""
    out = table.withColumn("shard", F.lit(0))
    for level in levels:
        out = out.withColumn("shard", _sides(F.col("shard"), level))
    return out


def sharded(table: DataFrame, dimensions: int, shards: int) -> DataFrame:
    """table(_size, _k, doc_id, ...) + shard, slot; a written table, as its rows are told apart by their place."""
    row = F.get("_k", F.lit(dimensions + OTHER_KEYS - 1))
    by_shard = placed(table, tree(table, dimensions, shards))
    rows = {r["shard"]: r["count"] for r in by_shard.groupBy("shard").count().collect()}       # a row a shard
    starts = [sum(rows.get(j, 0) for j in range(i)) for i in range(shards)]
    line = numbered(by_shard.withColumn("_row", row), [F.col("shard"), F.col("doc_id"), F.col("_row")], "_place")
    start = F.get(F.from_json(F.lit(json.dumps(starts)), "array<bigint>"), F.col("shard"))
    return line.withColumn("slot", F.col("_place") - start).drop("_place", "_row")


def write_shards(docs: DataFrame, path: str, target_bytes: int, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Write docs as Parquet, a folder for each shard of at most about target_bytes of text, in the order of the slots;
    returns the table as written: the columns of docs, shard, slot."""
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    table = stash(with_keys(docs.select(*[F.col(f"`{c}`") for c in kept]), dimensions), "keyed")
    total = table.agg(F.sum("_size")).first()[0] or 0
    shards = max(1, -(-total // target_bytes))
    (sharded(table, len(dimensions), shards).drop("_size", "_crc", "_k")
     .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.select(*[F.col(f"`{c}`") for c in kept]).schema)
    return docs.sparkSession.read.schema(f"{kinds}, slot long, shard int").parquet(path)


def shard_digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; the law is near-equal bytes."""
    wanted = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys(["doc_id", "text", *DIMENSIONS])])
    table = stash(with_keys(wanted).select("doc_id", "_size", "_crc", "_k"), "points")
    return sharded(table, len(DIMENSIONS), shards).select(
        "doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def _sql(levels: int = 3) -> str:
    """The same tree with windows over sorted rows, `levels` levels of halves."""
    tree_sql = ""
    for i in range(levels):
        tree_sql += f"""
b{i} AS (
  SELECT *, (max(k0) OVER n - min(k0) OVER n) / nullif(max(k0) OVER () - min(k0) OVER (), 0)
            >= (max(k1) OVER n - min(k1) OVER n) / nullif(max(k1) OVER () - min(k1) OVER (), 0) AS first_wide,
         sum(size) OVER n AS bytes FROM n{i} WINDOW n AS (PARTITION BY shard)),
s{i} AS (
  SELECT *, sum(size) OVER (PARTITION BY shard ORDER BY CASE WHEN first_wide THEN k0 ELSE k1 END,
                            CASE WHEN first_wide THEN k1 ELSE k0 END, k2, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM b{i}),
n{i + 1} AS (
  SELECT doc_id, size, crc, k0, k1, k2, 2 * shard + CASE WHEN 2 * upto - size <= bytes THEN 0 ELSE 1 END AS shard FROM s{i}),"""
    return f"""
WITH tbl AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i))),
n0 AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
         xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                                                                 lambda x: CAST('0x' || x AS BIGINT))),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc,
         coalesce(CAST(CAST('0x' || rpad(left(hex(encode(lang)), 12), 12, '0') AS BIGINT) AS DOUBLE), -1) AS k0,
         coalesce(CAST(n_chars AS DOUBLE), -1) AS k1,
         CAST(CAST('0x' || left(md5(coalesce(text, '')), 12) AS BIGINT) AS DOUBLE) AS k2, 0 AS shard FROM documents, tbl),{tree_sql}
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM n{levels}"""


SQL = _sql()
