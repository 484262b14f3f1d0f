"""Incremental jobs on file streams: resumable ingest, running statistics, running accuracy.

Every job runs with the AvailableNow trigger: it processes what has arrived since its checkpoint and stops, so
running it again resumes. Checkpoints and outputs belong in the shared folder.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType


def observations(spark: SparkSession, path: str, schema: StructType, pattern: str = "*.parquet",
                 files_per_batch: int = 1000) -> DataFrame:
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_batch).parquet(path))


def _wait(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def _batches(stream: DataFrame, write, checkpoint: str) -> None:
    _wait(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
          .trigger(availableNow=True).start())


def ingest(stream: DataFrame, keys: list[str], out: str, checkpoint: str) -> None:
    """Append every observation whose keys are not there yet, however late it arrives. Each batch is a folder of its
    own (epoch); a repeated batch replaces its folder, so it must not see its own earlier attempt."""
    def write(batch: DataFrame, epoch: int) -> None:
        spark, fresh = batch.sparkSession, batch.dropDuplicates(keys)
        if epoch > 0:                                   # the first batch finds nothing written
            written = StructType(batch.select(*keys).schema.fields).add("epoch", "long")
            done = (spark.read.schema(written).option("basePath", out).parquet(out).where(F.col("epoch") < epoch)
                    .select(*[F.col(k).alias(f"_done_{k}") for k in keys]))
            fresh = fresh.join(done, [F.col(k).eqNullSafe(F.col(f"_done_{k}")) for k in keys], "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
    _batches(stream, write, checkpoint)


def _partials(stream: DataFrame, aggregate, out: str, checkpoint: str) -> None:
    """Aggregates of every batch alone, one folder per batch (epoch): no state, nothing is too late, and a repeated
    batch replaces its own folder. Readers merge the batches."""
    _batches(stream, lambda batch, epoch: aggregate(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}"),
             checkpoint)


def _merged(parts: DataFrame, keys: list[str], means: list[str], products: dict) -> DataFrame:
    """Counts, means and centred population products of the batches as those of all rows together.

    products: {column: (mean column, mean column)}, each the population (co)variance of a batch. The product of the
    whole is the mean of the batch products plus the (co)variance of the batch means."""
    whole = Window.partitionBy(*keys)
    n = F.col("n")
    centred = parts.where(n > 0).withColumns({f"_{m}": F.sum(n * F.col(m)).over(whole) / F.sum(n).over(whole) for m in means})
    return centred.groupBy(*keys).agg(
        F.sum("n").alias("n"), *[F.first(f"_{m}").alias(m) for m in means],
        *[(F.sum(n * (F.col(p) + (F.col(a) - F.col(f"_{a}")) * (F.col(b) - F.col(f"_{b}")))) / F.sum(n)).alias(p)
          for p, (a, b) in products.items()])


def running_statistics(stream: DataFrame, time: str, keys: list[str], value: str, window: str, out: str,
                       checkpoint: str) -> None:
    """Count, mean and variance per key and time window, read by `statistics`. An exact median is not incremental: it
    is computed from the ingested table."""
    def of(batch: DataFrame) -> DataFrame:
        return (batch.groupBy(*keys, F.window(time, window).alias("_w"))
                .agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))
                .withColumn("start", F.col("_w.start")).drop("_w"))
    _partials(stream, of, out, checkpoint)


def statistics(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """(keys, start, n, mean, variance) of all batches; windows without a value give no row."""
    return _merged(spark.read.option("basePath", out).parquet(out), [*keys, "start"], ["mean"], {"variance": ("mean", "mean")})


def running_accuracy(stream: DataFrame, keys: list[str], pred: Column, ref: Column, out: str,
                     checkpoint: str) -> None:
    """Pooled accuracy moments per key, read by `accuracy`."""
    d = F.col("p") - F.col("t")

    def of(batch: DataFrame) -> DataFrame:
        pairs = (batch.select(*keys, pred.cast("double").alias("p"), ref.cast("double").alias("t"))
                 .where("p IS NOT NULL AND t IS NOT NULL"))
        return pairs.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.avg(d).alias("me"), F.avg(d * d).alias("mse"), F.avg("p").alias("mp"),
            F.avg("t").alias("mt"), F.var_pop("p").alias("vp"), F.var_pop("t").alias("vt"), F.covar_pop("p", "t").alias("cov"))
    _partials(stream, of, out, checkpoint)


def accuracy(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """(keys, n, me, rmse, r2) of all batches; r2 is NULL when a variance is 0."""
    all_ = _merged(spark.read.option("basePath", out).parquet(out), keys, ["me", "mse", "mp", "mt"],
                   {"vp": ("mp", "mp"), "vt": ("mt", "mt"), "cov": ("mp", "mt")})
    ok = (F.col("vp") > 0) & (F.col("vt") > 0)
    return all_.select(*keys, "n", "me", F.sqrt("mse").alias("rmse"),
                       F.when(ok, F.col("cov") * F.col("cov") / F.when(ok, F.col("vp") * F.col("vt"))).alias("r2"))
