"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words. Its documents stand in a line (by size, then by a hash), each with the
same number of expected copies, target / size of the source; one random offset per source is added to the running sum
of these, and a document is emitted once for every integer that its stretch of the sum crosses. As neighbours in the
line have nearly the same size, the words taken come near the target, and no document is taken more than three times.

The running sum is never one task: the line is cut into blocks (source, size class, hash bucket), positions are
numbered inside each block, and only the block counts are summed along a source.

`mix` carries whole rows through the line, so the copies belong to rows and not to ids: what a source takes is what the
mix holds of it, with NULL and repeated ids too.

Defined results: NULL or empty texts have size 0 and take 0 words, but stand in the line; a NULL source is a source
(the last one); a source without words has target 0 and emits nothing; no rows give no rows; repeated rows are
separate documents; rows without id stand where the hash of their text puts them; other columns are kept by `mix`.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .text import documents, n_words

BUCKETS = 256           # hash buckets of each size class of a source
MOST = 3                # most copies of a document, and most of a target in sizes of its source
SEED = "mix-1"          # of the offsets and of the order in a block


def _digest(c: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(c.cast("string"), F.lit("~"))))


def _integer(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """sources(source, source_size) + w: 1..cycle repeating by code point order, NULL last."""
    w = Window.orderBy(F.col("source").asc_nulls_last())        # one row per source
    return sources.withColumn("w", (F.pmod(F.row_number().over(w) - 1, F.lit(cycle)) + 1).cast("double"))


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """sources(source, source_size, w) + target: all sizes shared by weight, never above `most` times the own size.

    Resharing the excess until none is above ends at target = min(most * size, level * w). The level is found from
    sources in the order of size / w: those below it are full, the rest share what remains."""
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    cap = F.lit(most) * F.col("source_size").cast("double")
    level = ((F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
             / F.sum("w").over(from_here))
    at = sources.withColumn("_level", level).withColumn("_cap", cap)
    open_level = F.max(F.when(F.col("_cap") >= F.col("_level") * F.col("w"), F.col("_level"))).over(everything)
    return (at.withColumn("target", F.least("_cap", F.coalesce(open_level * F.col("w"), F.col("_cap"))))
            .drop("_level", "_cap"))


def copies(sized: DataFrame, most: int = MOST, seed: str = SEED) -> DataFrame:
    """sized(source, size, key, tie, ...) + source_size, target, n_copies.

    key: what tells the documents of a source apart, the same in every run; tie: what tells rows of one key apart."""
    bits = F.bin("size")
    placed = (sized.withColumn("_class", F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, 4)))
              .withColumn("_hash", _digest(F.col("key"), seed))
              .withColumn("_bucket", F.pmod(_integer(F.substring("_hash", 1, 6)), F.lit(BUCKETS))))
    blocks = placed.groupBy("source", "_class", "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_words"))
    sums = targets(weights(blocks.groupBy("source").agg(F.sum("_words").alias("source_size"))), most)
    line = Window.partitionBy("source").orderBy("_class", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    draw = _integer(F.substring(_digest(F.col("source"), seed + ":offset"), 1, 4)) / F.lit(65536.0)
    starts = (blocks.withColumn("_before", F.coalesce(F.sum("_n").over(line), F.lit(0)))
              .join(sums.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
              .withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
              .withColumn("_draw", draw).withColumn("_named", F.col("source").isNotNull()).withColumn("_source", F.coalesce("source", F.lit("")))
              .drop("_n", "_words", "w", "source"))
    # the window and the join share one shuffle of the rows: the same keys, none of them NULL
    at = ["_named", "_source", "_class", "_bucket"]
    block = Window.partitionBy(*at).orderBy("size", "_hash", "tie")
    upto = F.col("_draw") + F.col("_rate") * (F.col("_before") + F.col("_i")).cast("double")
    since = F.col("_draw") + F.col("_rate") * (F.col("_before") + F.col("_i") - 1).cast("double")
    return (placed.withColumn("_named", F.col("source").isNotNull()).withColumn("_source", F.coalesce("source", F.lit("")))
            .withColumn("_i", F.row_number().over(block)).join(starts, at)
            .withColumn("n_copies", F.least(F.lit(most), F.floor(upto) - F.floor(since)).cast("int"))
            .drop(*at, "_hash", "_i", "_before", "_rate", "_draw"))


def _key() -> Column:
    """What tells the rows of a source apart: the id, without one the text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.md5(F.coalesce("text", F.lit("")))))


def sizes(docs: DataFrame) -> DataFrame:
    return documents(docs, "doc_id", "source", "text").select("doc_id", "source", n_words(F.col("text")).alias("size"), _key().alias("key"),
                                                              F.xxhash64("text").alias("tie"))


def mix_digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return copies(sizes(docs)).select("doc_id", "size", "source_size", "target",
                                      (F.col("size") * F.col("n_copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each row as often as it is taken, with the columns of `docs`."""
    rows = docs.select("source", n_words(F.col("text")).alias("size"), _key().alias("key"), F.xxhash64("text").alias("tie"),
                       F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"))
    return (copies(rows).where("n_copies > 0").select("_doc", F.explode(F.sequence(F.lit(1), F.col("n_copies")))).select("_doc.*"))


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), '~' || md5(coalesce(text, ''))) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
placed AS (
  SELECT *, lpad(CAST(length(bin(size)) AS VARCHAR), 2, '0') || left(bin(size), 4) AS cls,
         md5('{SEED}:' || key) AS h FROM sized),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w,
         md5('{SEED}:offset:' || coalesce(source, '~')) AS g FROM sized GROUP BY source),
l AS (
  SELECT *, ((SELECT CAST(sum(size) AS DOUBLE) FROM sized)
             - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM s),
t AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), coalesce(
           (SELECT max(lv) FROM l WHERE 3.0::DOUBLE * source_size >= lv * w) * w, CAST(3 * source_size AS DOUBLE))) AS target,
         CAST(('0x' || left(g, 4)) AS INTEGER) / 65536.0::DOUBLE AS u FROM l),
p AS (
  SELECT placed.*, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS r,
         row_number() OVER (PARTITION BY placed.source
           ORDER BY cls, CAST(('0x' || left(h, 6)) AS INTEGER) % {BUCKETS}, size, h) AS i
  FROM placed JOIN t ON placed.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * least(3, CAST(floor(u + r * i) - floor(u + r * (i - 1)) AS BIGINT)) AS taken FROM p"""
