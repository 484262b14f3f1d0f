"""Query registry and the stand-in views over the supplied tables (Spark and SQL side by side)."""
from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import configure, stash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(ids: str, sql: str | None = None):
    """Register a function of Tables under its own name; ids: the inventory entries it shows."""
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, folder: fn(Tables(configure(spark), folder))
        COVERS[fn.__name__] = ids
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return add


def rnd(c: Column, n: int = 6) -> Column:
    return F.round(c.cast("double"), n)


def R(expr: str, n: int = 6) -> str:
    """Rounded double in SQL without a negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {n}) + 0.0)"


def big(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


class Tables:
    """The supplied parquet tables and the views of this domain built from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def obs(self) -> DataFrame:
        """Observations of pixels over time."""
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("sid"), F.floor(F.col("l_partkey") / 50).alias("r"),
            (F.col("l_partkey") % 50).alias("c"), F.col("l_suppkey").alias("cell"), F.col("l_shipdate").alias("t"),
            F.col("l_quantity").alias("b1"), F.col("l_extendedprice").alias("b2"),
            (F.col("l_discount") * 100).alias("prob"), F.nullif(F.col("l_tax"), F.lit(0.0)).alias("aux"),
            F.when(F.col("l_returnflag") == "N", 1).otherwise(0).alias("quality"),
            F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("degrade"))

    @cached_property
    def scene(self) -> DataFrame:
        """Scene metadata."""
        return self.read("orders").select(
            F.col("o_orderkey").alias("sid"), F.col("o_orderdate").alias("t"), (F.col("o_custkey") % 20).alias("orbit"),
            (F.col("o_totalprice") / 5000).alias("cloud"), F.col("o_orderstatus").alias("pol"))

    @cached_property
    def pairs(self) -> DataFrame:
        """Prediction and reference per chip pixel."""
        return self.read("lineitem").select(
            F.col("l_suppkey").alias("chip"), F.col("l_returnflag").alias("model"),
            (F.col("l_extendedprice") / 1250).alias("ref"),
            F.when(F.col("l_discount") != 0, F.col("l_quantity") * 1.6).alias("pred"))

    @cached_property
    def raster(self) -> DataFrame:
        """Dense grid of one value, 50 pixels wide, with a class."""
        return self.read("part").select(
            F.floor(F.col("p_partkey") / 50).alias("r"), (F.col("p_partkey") % 50).alias("c"),
            F.col("p_retailprice").alias("v"), F.col("p_size").alias("class"))

    @cached_property
    def relief(self) -> DataFrame:
        """Dense grid with a rougher surface."""
        return self.raster.select("r", "c", (F.col("v") + F.col("class")).alias("v"))

    @cached_property
    def emb(self) -> DataFrame:
        """Pixels with 64 band values and a label, 25 pixels wide."""
        return self.read("embeddings").select(
            F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 25).alias("r"), (F.col("vec_id") % 25).alias("c"),
            "embedding", "label")

    @cached_property
    def cells(self) -> DataFrame:
        """Planned cells, ten columns wide."""
        s = F.col("s_suppkey")
        col, row = (s % 10), F.floor(s / 10)
        return self.read("supplier").select(
            F.concat(F.lit("cell"), s.cast("string")).alias("cell"), s.alias("ord"), col.alias("col"), row.alias("row"),
            (col * 2560.0).alias("x0"), (row * -2560.0).alias("y1"),
            (F.abs("s_acctbal") / 10000).alias("water"), F.col("s_nationkey").alias("nation"))

    @cached_property
    def layer(self) -> DataFrame:
        """Long layer table: one value per layer and pixel of a 1024 x 512 grid."""
        px = (self.read("lineitem").groupBy(F.col("l_returnflag").alias("layer"), (F.col("l_orderkey") % 1024).alias("r"),
                                            (F.col("l_partkey") % 512).alias("c"))
              .agg(F.avg("l_quantity").alias("v")))
        return stash(px, "layer")                      # the stand-in for a stored layer table

    @cached_property
    def mask(self) -> DataFrame:
        """Inside pixels of the layer grid."""
        return (self.read("lineitem").where("l_linestatus = 'O'")
                .select((F.col("l_orderkey") % 1024).alias("r"), (F.col("l_partkey") % 512).alias("c")).distinct())

    @cached_property
    def gedi(self) -> DataFrame:
        """Sparse labels on the layer grid, some above the cap and some 0."""
        return (self.read("lineitem").where("l_linenumber = 1")
                .groupBy((F.col("l_orderkey") % 1024).alias("r"), (F.col("l_partkey") % 512).alias("c"))
                .agg((F.max("l_extendedprice") / 1000 - 1).alias("v")))

    @cached_property
    def area_docs(self) -> DataFrame:
        """One GeoJSON document per supplier: a triangle on the raster grid, every seventh a two-part collection."""
        x, y = self._corner()
        tri = "concat('{{\"type\":\"Polygon\",\"coordinates\":[[[', {x}, ',', {y}, '],[', {x} + 83, ',', {y} - 21, '],[', " \
              "{x} + 29, ',', {y} - 97, '],[', {x}, ',', {y}, ']]]}}')"
        one = tri.format(x=x, y=y)
        two = tri.format(x=f"({x} + 150)", y=y)
        return self.read("supplier").selectExpr(
            "s_suppkey AS id", "s_acctbal AS balance",
            f"CASE WHEN s_suppkey % 7 = 0 THEN concat('{{\"type\":\"FeatureCollection\",\"features\":["
            f"{{\"type\":\"Feature\",\"properties\":{{}},\"geometry\":', {one}, '}},"
            f"{{\"type\":\"Feature\",\"geometry\":{{\"type\":\"Point\",\"coordinates\":[1,2]}}}},"
            f"{{\"type\":\"Feature\",\"geometry\":', {two}, '}}]}}') "
            f"WHEN s_suppkey % 7 = 1 THEN concat('{{\"type\":\"Feature\",\"geometry\":', {one}, '}}') "
            f"ELSE {one} END AS doc")

    @staticmethod
    def _corner() -> tuple[str, str]:
        return "(10 * ((s_suppkey * 7) % 41) + 3)", "(-10 * ((s_suppkey * 5) % 31) - 2)"


# ---- the same views for SQL ----
OBS = """(SELECT l_orderkey AS sid, CAST(floor(l_partkey / 50) AS BIGINT) AS r, l_partkey % 50 AS c, l_suppkey AS cell,
 l_shipdate AS t, l_quantity AS b1, l_extendedprice AS b2, l_discount * 100 AS prob, nullif(l_tax, 0) AS aux,
 CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS quality, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS degrade
 FROM lineitem)"""
SCENE = """(SELECT o_orderkey AS sid, o_orderdate AS t, o_custkey % 20 AS orbit, o_totalprice / 5000 AS cloud,
 o_orderstatus AS pol FROM orders)"""
PAIRS = """(SELECT l_suppkey AS chip, l_returnflag AS model, l_extendedprice / 1250 AS ref,
 CASE WHEN l_discount <> 0 THEN l_quantity * 1.6 END AS pred FROM lineitem)"""
RASTER = """(SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS r, p_partkey % 50 AS c, p_retailprice AS v, p_size AS class
 FROM part)"""
RELIEF = f"(SELECT r, c, v + class AS v FROM {RASTER})"
EMB = """(SELECT vec_id AS id, CAST(floor(vec_id / 25) AS BIGINT) AS r, vec_id % 25 AS c, embedding, label
 FROM embeddings)"""
CELLS = """(SELECT 'cell' || CAST(s_suppkey AS VARCHAR) AS cell, s_suppkey AS ord, s_suppkey % 10 AS col,
 CAST(floor(s_suppkey / 10) AS BIGINT) AS row, (s_suppkey % 10) * 2560.0::DOUBLE AS x0,
 floor(s_suppkey / 10) * -2560.0::DOUBLE AS y1, abs(s_acctbal) / 10000 AS water, s_nationkey AS nation FROM supplier)"""
LAYER = """(SELECT l_returnflag AS layer, l_orderkey % 1024 AS r, l_partkey % 512 AS c, avg(l_quantity) AS v
 FROM lineitem GROUP BY ALL)"""
MASK = """(SELECT DISTINCT l_orderkey % 1024 AS r, l_partkey % 512 AS c FROM lineitem WHERE l_linestatus = 'O')"""
GEDI = """(SELECT l_orderkey % 1024 AS r, l_partkey % 512 AS c, max(l_extendedprice) / 1000 - 1 AS v
 FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL)"""
_X, _Y = Tables._corner()
AREAS = f"""(SELECT s_suppkey AS id, 0 AS part, CAST({_X} AS DOUBLE) AS x, CAST({_Y} AS DOUBLE) AS y FROM supplier
 UNION ALL SELECT s_suppkey, 1, CAST({_X} + 150 AS DOUBLE), CAST({_Y} AS DOUBLE) FROM supplier WHERE s_suppkey % 7 = 0)"""
EDGES = f"""(SELECT id, part, 0 AS seq, x AS x1, y AS y1, x + 83 AS x2, y - 21 AS y2 FROM {AREAS}
 UNION ALL SELECT id, part, 1, x + 83, y - 21, x + 29, y - 97 FROM {AREAS}
 UNION ALL SELECT id, part, 2, x + 29, y - 97, x, y FROM {AREAS})"""
