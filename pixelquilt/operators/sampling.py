"""Deterministic samples and splits."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scale import numbered, portable_hash

RANK_BITS = 12


def subset(df: DataFrame, max_rows: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly max_rows rows without replacement (all, if there are fewer), by the smallest hash of `key`.

    No global sort and no row limit: the hash buckets are counted, every bucket below the border is kept whole and
    only the border bucket (1 / 2^19 of the rows) is ranked. Ties of the hash are ordered by the key.
    """
    h = df.withColumn("_h", portable_hash(F.col(key), seed)).withColumn("_b", F.shiftright("_h", RANK_BITS))
    counts = h.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)      # at most 2^19 buckets
    border = (counts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
              .where(F.col("_before") < max_rows)
              .select("_b", F.least(F.col("_n"), max_rows - F.col("_before")).alias("_take"), "_n"))
    kept = h.join(F.broadcast(border), "_b")                                    # at most 2^19 rows of three integers
    whole = kept.where("_take = _n").drop("_b", "_h", "_take", "_n")
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    part = kept.where("_take < _n").withColumn("_i", rank).where("_i <= _take")
    return whole.unionByName(part.drop("_b", "_h", "_take", "_n", "_i"))


def row_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Row-level split by hash: `test` is true for about `test_share` of the keys."""
    return df.withColumn("test", portable_hash(F.col(key), seed) < F.lit(int(test_share * 2147483648)))


def split_chips(chips: DataFrame, val_share: float = 0.2, seed: int = 42, how: str = "train_test_split") -> DataFrame:
    """Chips with `val`, by the rank of the hash of the chip id; one rule at every size, no list on the driver.

    train_test_split: the first ceil(share * n) validate; shuffle: the first floor(share * n).
    """
    if how not in ("train_test_split", "shuffle"):
        raise ValueError(how)
    n = chips.count()
    k = math.ceil(val_share * n) if how == "train_test_split" else math.floor(val_share * n)
    chosen = subset(chips.select("chip"), k, "chip", seed).withColumn("val", F.lit(True))
    return chips.join(chosen, "chip", "left").withColumn("val", F.coalesce("val", F.lit(False)))


def every_nth(df: DataFrame, order: list, n: int) -> DataFrame:
    """Every n-th row of the given total order."""
    return numbered(df, order, "_i").where(F.col("_i") % n == 0).drop("_i")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows of every key; Spark keeps only k rows per key and partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
