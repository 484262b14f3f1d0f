"""Incremental jobs over the event table as a file stream."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import fresh_path
from ..streaming import jobs as J
from .base import R, Tables, query, rnd


def _events(t: Tables) -> DataFrame:
    schema = t.read("events").schema
    stream = J.observations(t.spark, t.folder, schema, "events.parquet")
    return stream.withColumn("t", F.col("ts").cast("timestamp"))


@query("T1", f"SELECT event_type, count(*) AS n, {R('sum(value)', 4)} AS total FROM events GROUP BY 1")
def stream_ingest(t: Tables):
    out, mark = fresh_path(t.spark, "ingest"), fresh_path(t.spark, "marks")
    J.ingest(_events(t).select("event_id", "t", "user_id", "event_type", "value"), ["event_id"], out, mark)
    return t.spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("value"), 4).alias("total"))


@query("T2", f"""SELECT user_id, CAST(floor(epoch(ts) / 604800) AS BIGINT) AS week, count(*) AS n, {R('avg(value)', 8)} AS mean, {R('sqrt(var_pop(value))')} AS deviation
 FROM events GROUP BY ALL""")
def stream_statistics(t: Tables):
    out, mark = fresh_path(t.spark, "statistics"), fresh_path(t.spark, "marks")
    J.running_statistics(_events(t), "t", ["user_id"], "value", "7 days", out, mark)
    week = F.floor(F.unix_timestamp("start") / 604800)
    return J.statistics(t.spark, out, ["user_id"]).select("user_id", week.alias("week"), "n", rnd(F.col("mean"), 8).alias("mean"),
                                                             rnd(F.sqrt("variance")).alias("deviation"))


@query("T3 E10 D13", f"""SELECT event_type, count(*) AS n, {R('avg(p - t)')} AS me, {R('sqrt(avg((p - t) ** 2))')} AS rmse, {R('covar_pop(p, t) ** 2 / (var_pop(p) * var_pop(t))')} AS r2
 FROM (SELECT event_type, value AS p, CAST(props->>'k' AS DOUBLE) AS t FROM events) GROUP BY 1""")
def stream_accuracy(t: Tables):
    out, mark = fresh_path(t.spark, "accuracy"), fresh_path(t.spark, "marks")
    ref = F.get_json_object("props", "$.k")
    J.running_accuracy(_events(t), ["event_type"], F.col("value"), ref, out, mark)
    done = J.accuracy(t.spark, out, ["event_type"])
    return done.select("event_type", "n", *[rnd(F.col(c)).alias(c) for c in ("me", "rmse", "r2")])
