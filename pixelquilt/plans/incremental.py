"""What is out of date: fingerprints, stack and model identity, completeness."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.encode import canonical_name


def fingerprint_diff(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """(key, change) of inputs that changed, appeared or went missing between two sets (key, size, mtime)."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    same = F.col("o.size").eqNullSafe(F.col("n.size")) & F.col("o.mtime").eqNullSafe(F.col("n.mtime"))
    change = (F.when(F.col(f"o.{key}").isNull(), "new").when(F.col(f"n.{key}").isNull(), "missing")
              .when(~same, "changed"))
    return (joined.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), change.alias("change"))
            .where("change IS NOT NULL"))


def stack_state(states: DataFrame) -> DataFrame:
    """Why each stack must be rebuilt ('' = up to date). Columns: has_fingerprint, cells_sha, plan_sha, parts_ok,
    inputs_ok, settings, wanted_settings, n_changed."""
    reason = (F.when(~F.col("has_fingerprint"), "no fingerprint")
              .when(F.col("cells_sha") != F.col("plan_sha"), "cells changed")
              .when(~F.col("parts_ok"), "parts missing or left over")
              .when(~F.col("inputs_ok"), "inputs missing")
              .when(~F.col("settings").eqNullSafe(F.col("wanted_settings")), "settings changed")
              .when(F.col("n_changed") > 0, F.format_string("%d inputs changed", "n_changed")).otherwise(""))
    return states.withColumn("reason", reason)


def left_over(present: DataFrame, listed: DataFrame) -> DataFrame:
    """Parts on disk that the fingerprint does not list, and listed parts that are missing."""
    extra = present.select("part").exceptAll(listed.select("part")).withColumn("state", F.lit("left over"))
    gone = listed.select("part").exceptAll(present.select("part")).withColumn("state", F.lit("missing"))
    return extra.unionByName(gone)


def complete_cells(existing: DataFrame, needed: list[str]) -> DataFrame:
    """Cells that have every needed layer (relational division)."""
    return (existing.where(F.col("layer").isin(*needed)).groupBy("cell")
            .agg(F.count_distinct("layer").alias("_n")).where(F.col("_n") == len(set(needed))).select("cell"))


def lacking_cells(cells: DataFrame, existing: DataFrame, needed: list[str]) -> DataFrame:
    return cells.select("cell").distinct().join(complete_cells(existing, needed), "cell", "left_anti")


def map_current(maps: DataFrame, inputs: DataFrame) -> DataFrame:
    """(map, current): a map is current when it is at least as new as every existing input (map, t)."""
    newest = inputs.groupBy("map").agg(F.max("t").alias("newest"))
    return (maps.join(newest, "map", "left")
            .select("map", (F.col("newest").isNull() | (F.col("t") >= F.col("newest"))).alias("current")))


def model_currency(models: DataFrame, stack: DataFrame) -> DataFrame:
    """(model, current, reason): was each model trained on the current stack.

    models: model, kind ('forest' or 'network'), file_exists, finished, run_stack_id, input, n_rows, n_chips, parts,
    seasonal_parts, teacher_id. stack: one row stack_id, input, labels, chips, parts, seasonal_parts, teacher_id.
    A recorded stack id decides; older runs are compared by input, then rows (forest) or parts and chips (network).
    """
    fields = ["stack_id", "input", "labels", "chips", "parts", "seasonal_parts", "teacher_id"]
    now = stack.select(F.struct(*fields).alias("now")).scalar()
    m = models.withColumn("now", now)
    named = canonical_name(F.col("input"))
    reason = (F.when(F.col("now.stack_id").isNull(), "the training stack is incomplete")
              .when(~F.col("file_exists"), "model file missing")
              .when(F.col("run_stack_id").isNotNull() & (F.col("run_stack_id") != F.col("now.stack_id")),
                    "trained on another training stack")
              .when(F.col("run_stack_id").isNull() & ~F.col("finished"), "no finished run")
              .when(F.col("input").isNotNull() & (named != F.col("now.input")),
                    F.concat(F.lit("trained with input "), named))
              .when(F.col("run_stack_id").isNull() & (F.col("kind") == "forest")
                    & ~F.col("n_rows").eqNullSafe(F.col("now.labels")), "trained on another number of labels")
              .when(F.col("run_stack_id").isNull() & (F.col("kind") == "network")
                    & ~(F.col("n_chips").eqNullSafe(F.col("now.chips")) & F.col("parts").eqNullSafe(F.col("now.parts"))),
                    "trained on other chips")
              .when(F.col("run_stack_id").isNull() & (F.col("kind") == "network")
                    & ~F.col("seasonal_parts").eqNullSafe(F.col("now.seasonal_parts")),
                    "trained on other seasonal parts")
              .when(F.col("teacher_id").isNotNull() & F.col("now.teacher_id").isNotNull()
                    & (F.col("teacher_id") != F.col("now.teacher_id")), "its teacher has changed").otherwise(""))
    return m.select("model", (reason == "").alias("current"), reason.alias("reason"))


def mosaic_currency(mosaics: DataFrame, inputs: DataFrame, wanted_input: str) -> DataFrame:
    """(mosaic, current): built for the wanted input and at least as new as the newest plan, settings, area or raw
    layer file (inputs: t)."""
    newest = inputs.agg(F.max("t").alias("t")).scalar()
    fresh = F.coalesce(F.col("t") >= newest, F.lit(True))
    return mosaics.select("mosaic", (fresh & F.col("input").eqNullSafe(F.lit(wanted_input))).alias("current"))


def held_out(train: DataFrame, validation: DataFrame, models: DataFrame) -> DataFrame:
    """(model, overlap, status): how many validation chips were training chips of each model (train: model, chip)."""
    seen = (train.join(validation.select("chip").distinct(), "chip", "left_semi").select("model", "chip").distinct()
            .groupBy("model").agg(F.count(F.lit(1)).alias("overlap")))
    n = validation.agg(F.count_distinct("chip")).scalar()
    known = train.select("model").distinct().withColumn("_known", F.lit(True))
    joined = (models.select("model").join(known, "model", "left").join(seen, "model", "left")
              .withColumn("overlap", F.when(F.col("_known"), F.coalesce("overlap", F.lit(0)))))
    status = (F.when(F.col("_known").isNull(), "unknown").when(F.col("overlap") == 0, "held-out")
              .when(F.col("overlap") == n, "in-sample").otherwise("partly in-sample"))
    return joined.select("model", "overlap", status.alias("status"))


def content_hash(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """Order-independent content hash per key: count, sum and xor of 60-bit row hashes (constant-size, mergeable)."""
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    parts = rows.withColumn("_h", h).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_h").cast("decimal(38,0)")).alias("_s"), F.bit_xor("_h").alias("_x"))
    return parts.select(*keys, "n", F.md5(F.concat_ws("-", "n", "_s", "_x")).alias("hash"))


def stack_identity(hashes: DataFrame, part: str = "part") -> DataFrame:
    """One identity of all part hashes, whatever their order."""
    return content_hash(hashes, [], F.concat_ws(":", part, "hash")).select(F.col("hash").alias("stack_id"))
