"""Building blocks that keep results exact when one group holds a large share of all rows.

Sums, counts, extremes and min_by / max_by have constant-size buffers and combine before the shuffle, so a hot
group costs nothing extra. Two things do not: exact percentiles (the buffer grows with the distinct values of the
group) and global numbering (an unpartitioned window is one task). Both are solved here.
"""
from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from .session import stash

GROUP_ROWS = 100_000        # most values of one group that are held as an array
HOT_GROUPS = 10_000         # most hot groups handled by the (then provably small) broadcast list
MAX_SLOTS = 10_000          # most value ranges one hot group is cut into
SMALL_ROWS = 1_000_000      # most rows of a counted lookup table that is broadcast


def hot_groups(df: DataFrame, keys: list[str], limit: int):
    """(rows of the groups larger than `limit`, largest size); rows is None when there are more than HOT_GROUPS.

    Reads the key columns only and combines before the shuffle; at most HOT_GROUPS + 1 rows reach the driver.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    rows = sizes.limit(HOT_GROUPS + 1).collect()
    if len(rows) > HOT_GROUPS:
        return None, sizes.agg(F.max("_n")).first()[0]
    return rows, max((r["_n"] for r in rows), default=0)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by name in which a NULL key meets a NULL key."""
    named = right.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys))
    return left.join(named, same, how).drop(*[f"_on_{k}" for k in keys])


def quantile_of_sorted(values: Column, q: float) -> Column:
    """Linearly interpolated percentile of a sorted array; NULL when it is empty."""
    pos = F.lit(float(q)) * (F.size(values) - 1)
    low, high = F.get(values, F.floor(pos).cast("int")), F.get(values, F.ceil(pos).cast("int"))
    f = pos - F.floor(pos)
    return (1 - f) * low + f * high


def _interpolated(values: Column, n: Column, q: float) -> Column:
    pos = F.lit(q) * (n - F.lit(1))
    low, high = F.floor(pos).cast("long"), F.ceil(pos).cast("long")
    a, b = F.element_at(values, low), F.element_at(values, high)
    f = pos - F.floor(pos)
    return (1 - f) * a + f * b


def _split_quantiles(df: DataFrame, keys: list[str], spec: dict, biggest: int, limit: int) -> DataFrame:
    """Exact interpolated percentiles of groups of any size.

    Equal values are counted first (their copies collapse before the shuffle). If no group has more than `limit` different
    ones, a running count finds the ranks. Otherwise a mergeable sketch cuts every group into value ranges of about
    `limit` distinct values, the counts of the ranges tell which range holds each wanted rank, and only those ranges are
    sorted. The sketch decides the balance, never the result.
    """
    columns = sorted({c for c, _ in spec.values()})
    by = [*keys, "_col"]
    pairs = F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_v")) for c in columns])
    counts = stash(df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.*").where("_v IS NOT NULL")
                   .groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")), "counts")
    ranks = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor(F.lit(q) * (F.col("_total") - 1)).cast("long"),
                F.ceil(F.lit(q) * (F.col("_total") - 1)).cast("long"))
        for q in sorted({q for _, q in spec.values()})])))
    if (counts.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= limit:
        # few distinct values in every group, however many rows: ranks straight from the running counts
        group = Window.partitionBy(*by)
        upto = group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
        found = (counts.withColumn("_total", F.sum("_n").over(group)).withColumn("_end", F.sum("_n").over(upto))
                 .withColumn("_rank", F.explode(F.filter(ranks, lambda r: (r >= F.col("_end") - F.col("_n")) & (r < F.col("_end"))))))
    else:
        slots = min(MAX_SLOTS, max(2, math.ceil(biggest / limit)))
        cuts = F.percentile_approx("_v", F.array(*[F.lit(i / slots) for i in range(1, slots)]), max(10_000, 20 * slots))
        bounds = counts.groupBy(*by).agg(cuts.alias("_cuts"), F.sum("_n").alias("_total"))
        placed = null_safe_join(counts, bounds, by).withColumn(
            "_slot", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
        before = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
        wanted = (placed.groupBy(*by, "_slot").agg(F.sum("_n").alias("_rows"), F.first("_total").alias("_total"))
                  .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
                  .withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_before"))
                                                 & (r < F.col("_before") + F.col("_rows"))))
                  .where(F.size("_ranks") > 0).drop("_rows", "_total"))
        within = Window.partitionBy(*by, "_slot").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
        found = (null_safe_join(placed, wanted, [*by, "_slot"])
                 .withColumn("_end", F.col("_before") + F.sum("_n").over(within))
                 .withColumn("_rank", F.explode("_ranks"))
                 .where((F.col("_rank") >= F.col("_end") - F.col("_n")) & (F.col("_rank") < F.col("_end"))))
    per_column = found.groupBy(*keys).agg(*[
        item for c in columns for item in (
            # at most two ranks per wanted percentile
            F.map_from_entries(F.collect_set(F.when(F.col("_col") == c, F.struct("_rank", "_v")))).alias(f"_m_{c}"),
            F.max(F.when(F.col("_col") == c, F.col("_total"))).alias(f"_t_{c}"))])
    return per_column.select(*keys, *[
        F.when(F.col(f"_t_{c}").isNotNull(), _interpolated(F.col(f"_m_{c}"), F.col(f"_t_{c}"), q)).alias(name)
        for name, (c, q) in spec.items()])


def group_quantiles(df: DataFrame, keys: list[str], spec: dict, aggregates: list[Column] = (),
                    limit: int = GROUP_ROWS, probe: DataFrame | None = None,
                    probe_keys: list[str] | None = None, probe_each: int = 1) -> DataFrame:
    """Exact linearly interpolated percentiles per group, NULLs ignored.

    spec: {output name: (column, q in 0..1)}; aggregates: further constant-size aggregates of the same groups.
    Groups of at most `limit` rows are collected and sorted in one aggregation (about twice as fast as the percentile
    aggregate, whose buffers are hash maps); larger ones are split by value (_split_quantiles). NULL keys are groups. probe: a cheaper table that bounds the group sizes from above (for instance the unfiltered scan), counted by
    probe_keys, a subset of the keys; each of its rows stands for at most probe_each rows.
    """
    keys = list(keys)
    if not keys:
        out = group_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], spec, aggregates, limit)
        return out.drop("_all")
    on = list(probe_keys or keys)
    rows, biggest = hot_groups(df if probe is None else probe, on, limit // probe_each)
    biggest = (biggest or 0) * probe_each
    columns = sorted({c for c, _ in spec.values()})

    def plain(part: DataFrame) -> DataFrame:
        agg = part.groupBy(*keys).agg(
            *[F.sort_array(F.collect_list(F.col(c).cast("double"))).alias(f"_a_{c}") for c in columns], *aggregates)
        extra = [c for c in agg.columns if c not in keys and not c.startswith("_a_")]
        return agg.select(*keys, *[quantile_of_sorted(F.col(f"_a_{c}"), q).alias(name)
                                   for name, (c, q) in spec.items()], *extra)

    def split(part: DataFrame) -> DataFrame:
        quantiles = _split_quantiles(part, keys, spec, biggest, limit)
        if aggregates:
            rest = part.groupBy(*keys).agg(*aggregates)
        else:
            rest = part.select(*keys).distinct()
        extra = [c for c in rest.columns if c not in keys]
        return null_safe_join(rest, quantiles, keys, "left").select(*keys, *spec, *extra)

    if rows == []:
        return plain(df)
    if rows is None:                                    # too many hot groups for a broadcast list
        return split(df)
    listed = df.sparkSession.createDataFrame([tuple(r)[:-1] for r in rows], df.select(*on).schema)
    hot = F.broadcast(listed)                           # at most HOT_GROUPS rows
    return (plain(null_safe_join(df, hot, on, "left_anti"))
            .unionByName(split(null_safe_join(df, hot, on, "left_semi"))))


def numbered(df: DataFrame, order: list, name: str = "ord") -> DataFrame:
    """Global 0-based position in the given order without a one-task window.

    Rows are range-partitioned and sorted, the sorted table is written once (so the partition borders cannot
    move), and every position is the offset of its partition plus the position inside it. `order` should be a
    total order; rows that tie are spread and ordered by a hash of the row, which a repeated task reproduces.
    """
    tied = df.withColumn("_tie", F.xxhash64(*df.columns))
    ranged = (tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
              .withColumn("_id", F.monotonically_increasing_id()))
    table = (stash(ranged, "numbered").withColumn("_part", F.shiftright("_id", 33))
             .withColumn("_pos", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))))
    # one row per partition: as many as spark.sql.shuffle.partitions
    parts = table.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (table.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_pos"))
            .drop("_part", "_pos", "_id", "_offset"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by the keys into spark.sql.shuffle.partitions before rows multiply. A fixed number, because the
    adaptive coalescing would size the partitions by the small input of the step instead of its large output; and
    aggregations or windows by these keys (and more) after it need no further shuffle."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def small(df: DataFrame, bound: DataFrame | None = None, rows: int = SMALL_ROWS) -> DataFrame:
    """`df` marked for broadcasting if it (or `bound`, a cheaper table with at least as many rows) has at most `rows`
    rows, so the large side of the join is not shuffled; otherwise unchanged, for a shuffled join."""
    n = (df if bound is None else bound).limit(rows + 1).count()
    return F.broadcast(df) if n <= rows else df


def portable_hash(key: Column, seed: int) -> Column:
    """31-bit mixing of an integer key that other SQL engines can reproduce; two linear-congruential rounds."""
    a = (F.pmod(key.cast("long"), F.lit(2147483647)) * 1103515245 + seed * 12345 + 1013904223) % 2147483648
    return (F.shiftright(a, 8) * 22695477 + a + 1) % 2147483648
