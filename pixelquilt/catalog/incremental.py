"""Fingerprints, currency and identity."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import incremental as I
from .base import Tables, query
from .planning import NEWEST, newest


def _sets(t: Tables):
    k = F.col("c_custkey")
    base = t.read("customer")
    old = base.where("c_acctbal >= 0").select(k.alias("key"), F.col("c_nationkey").cast("bigint").alias("size"), F.col("c_acctbal").alias("mtime"))
    new = base.where("c_nationkey <> 7").select(k.alias("key"), (F.col("c_nationkey") + F.when(F.col("c_nationkey") == 11, 1).otherwise(0)).cast("bigint").alias("size"),
                                         F.when(F.col("c_acctbal") > 9000, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("mtime"))
    return old, new


@query("C13 D15", """SELECT c_custkey AS key, CASE WHEN c_acctbal < 0 THEN 'new' WHEN c_nationkey = 7 THEN 'missing' ELSE 'changed' END AS change FROM customer
 WHERE NOT (c_acctbal < 0 AND c_nationkey = 7) AND (c_acctbal < 0 OR c_nationkey = 7 OR c_nationkey = 11 OR c_acctbal > 9000)""")
def changed_inputs(t: Tables):
    return I.fingerprint_diff(*_sets(t))


@query("C13", """SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'no fingerprint' WHEN c_nationkey <> c_custkey % 25 AND c_custkey % 4 = 0 THEN 'cells changed'
 WHEN c_custkey % 9 = 0 THEN 'parts missing or left over' WHEN c_custkey % 8 = 0 THEN 'inputs missing' WHEN c_mktsegment = 'BUILDING' THEN 'settings changed'
 WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 3 AS VARCHAR) || ' inputs changed' ELSE '' END AS reason FROM customer""")
def rebuild_reasons(t: Tables):
    k = F.col("c_custkey")
    states = t.read("customer").select(
        k.alias("id"), (k % 10 != 0).alias("has_fingerprint"), F.col("c_nationkey").cast("string").alias("cells_sha"),
        F.when(k % 4 == 0, k % 25).otherwise(F.col("c_nationkey")).cast("string").alias("plan_sha"), (k % 9 != 0).alias("parts_ok"),
        (k % 8 != 0).alias("inputs_ok"), F.col("c_mktsegment").alias("settings"),
        F.when(F.col("c_mktsegment") == "BUILDING", "x").otherwise(F.col("c_mktsegment")).alias("wanted_settings"), (k % 3).alias("n_changed"))
    return I.stack_state(states).select("id", "reason")


@query("I4", """SELECT o_custkey AS part, 'left over' AS state FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
 UNION ALL SELECT c_custkey, 'missing' FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def left_over_parts(t: Tables):
    present = t.read("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("part")).distinct()
    return I.left_over(present, t.read("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("part")))


EXIST = f"(SELECT l_suppkey AS cell, l_linenumber AS layer FROM {NEWEST} WHERE l_quantity <= 40)"


@query("C17", f"""SELECT s_suppkey AS cell, s_suppkey IN (SELECT cell FROM {EXIST} WHERE layer <= 3 GROUP BY cell HAVING count(*) = 3) AS complete FROM supplier""")
def complete_cells(t: Tables):
    have = newest(t).where("quantity <= 40").select("cell", F.col("line").cast("string").alias("layer"))
    cells = t.read("supplier").select(F.col("s_suppkey").alias("cell"))
    need = ["1", "2", "3"]
    full = cells.join(I.complete_cells(have, need), "cell", "left_semi").withColumn("complete", F.lit(True))
    return full.unionByName(I.lacking_cells(cells, have, need).withColumn("complete", F.lit(False)))


@query("C16 C21", """SELECT c_custkey AS map, m IS NULL OR c_acctbal * 60 >= m AS current FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def current_maps(t: Tables):
    maps = t.read("customer").select(F.col("c_custkey").alias("map"), (F.col("c_acctbal") * 60).alias("t"))
    return I.map_current(maps, t.read("orders").select(F.col("o_custkey").alias("map"), F.col("o_totalprice").alias("t")))


@query("C21", """SELECT c_custkey AS mosaic, c_acctbal * 60 >= (SELECT max(o_totalprice) - 100000 FROM orders) AND c_mktsegment = 'BUILDING' AS current FROM customer""")
def current_mosaics(t: Tables):
    mosaics = t.read("customer").select(F.col("c_custkey").alias("mosaic"), (F.col("c_acctbal") * 60).alias("t"), F.col("c_mktsegment").alias("input"))
    return I.mosaic_currency(mosaics, t.read("orders").select((F.col("o_totalprice") - 100000).alias("t")), "BUILDING")


@query("C20 B7", """WITH s AS (SELECT count(*) AS labels FROM orders WHERE o_totalprice > 250000),
 m AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'forest' ELSE 'network' END AS kind, c_custkey % 6 AS g FROM customer)
 SELECT k AS model, reason = '' AS current, reason FROM (SELECT k, CASE WHEN k % 19 = 0 THEN 'model file missing'
  WHEN g < 2 AND k % 5 = 0 THEN 'trained on another training stack' WHEN g >= 2 AND k % 23 = 0 THEN 'no finished run'
  WHEN k % 7 = 3 THEN 'trained with input A' WHEN g >= 2 AND kind = 'forest' AND k % 3 = 0 THEN 'trained on another number of labels'
  WHEN g >= 2 AND kind = 'network' AND k % 4 = 1 THEN 'trained on other chips' WHEN g >= 2 AND kind = 'network' AND k % 9 = 2 THEN 'trained on other seasonal parts'
  WHEN k % 29 = 1 THEN 'its teacher has changed' ELSE '' END AS reason FROM m, s)""")
def current_models(t: Tables):
    k = F.col("c_custkey")
    stack = t.read("orders").where("o_totalprice > 250000").agg(F.count(F.lit(1)).alias("labels")).select(
        F.lit("s1").alias("stack_id"), F.lit("AE").alias("input"), "labels", F.lit(10).alias("chips"), F.lit("p1,p2").alias("parts"),
        F.lit("").alias("seasonal_parts"), F.lit("t1").alias("teacher_id"))
    n = stack.select("labels").scalar()
    models = t.read("customer").withColumn("n_labels", n).select(
        k.alias("model"), F.when(k % 2 == 0, "forest").otherwise("network").alias("kind"), (k % 19 != 0).alias("file_exists"),
        (k % 23 != 0).alias("finished"), F.when(k % 6 < 2, F.when(k % 5 == 0, "s0").otherwise("s1")).alias("run_stack_id"),
        F.when(k % 7 == 3, "I").when(k % 7 == 4, "IE").otherwise("AE").alias("input"),
        (F.col("n_labels") + F.when(k % 3 == 0, 1).otherwise(0)).alias("n_rows"), F.when(k % 4 == 1, 9).otherwise(10).alias("n_chips"),
        F.lit("p1,p2").alias("parts"), F.when(k % 9 == 2, "q").otherwise("").alias("seasonal_parts"),
        F.when(k % 29 == 1, "t0").otherwise("t1").alias("teacher_id"))
    return I.model_currency(models, stack)


HASH = """(SELECT part, count(*) AS n, md5(CAST(count(*) AS VARCHAR) || '-' || CAST(sum(h::HUGEINT) AS VARCHAR) || '-' || CAST(bit_xor(h) AS VARCHAR)) AS hash
 FROM (SELECT l_suppkey AS part, ('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT))), 1, 15))::BIGINT AS h FROM lineitem) GROUP BY part)"""


def _hashes(t: Tables):
    text = F.concat_ws("|", "l_orderkey", "l_partkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    return I.content_hash(t.read("lineitem").withColumnRenamed("l_suppkey", "part"), ["part"], text)


@query("E31", f"SELECT part, n, hash FROM {HASH}")
def part_hashes(t: Tables):
    return _hashes(t)


@query("E31", f"""SELECT md5(CAST(count(*) AS VARCHAR) || '-' || CAST(sum(h::HUGEINT) AS VARCHAR) || '-' || CAST(bit_xor(h) AS VARCHAR)) AS stack_id
 FROM (SELECT ('0x' || substr(md5(concat_ws(':', part, hash)), 1, 15))::BIGINT AS h FROM {HASH})""")
def stack_identity(t: Tables):
    return I.stack_identity(_hashes(t))
