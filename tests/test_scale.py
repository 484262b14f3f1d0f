"""Skew-proof building blocks against NumPy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelquilt.operators.composite import counted_median
from pixelquilt.operators.sampling import every_nth, row_split, split_chips, subset, top_k
from pixelquilt.scale import group_quantiles, hot_groups, numbered, portable_hash


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 0 holds most rows, some values are copied often, some are missing."""
    rng = np.random.default_rng(3)
    rows = []
    for k, n in ((0, 4000), (1, 37), (2, 1), (3, 900)):
        v = np.round(rng.normal(10, 5, n), 2)
        v[: n // 3] = v[0]
        w = np.where(rng.random(n) < 0.1, np.nan, rng.random(n))
        rows += [(k, float(a), None if np.isnan(b) else float(b)) for a, b in zip(v, w)]
    rows += [(4, 1.0, None), (4, 2.0, None)]
    return rows


def expected(rows, col, q):
    out = {}
    for k in {r[0] for r in rows}:
        v = [r[col] for r in rows if r[0] == k and r[col] is not None]
        out[k] = float(np.quantile(v, q)) if v else None
    return out


@pytest.mark.parametrize("limit", [10 ** 9, 500, 10])
def test_group_quantiles(spark, skewed, limit):
    df = frame(spark, skewed, "k int, v double, w double")
    got = group_quantiles(df, ["k"], {"p10": ("v", 0.1), "med": ("v", 0.5), "w90": ("w", 0.9)},
                          [F.count(F.lit(1)).alias("n")], limit=limit).collect()
    assert len(got) == 5
    for name, col, q in (("p10", 1, 0.1), ("med", 1, 0.5), ("w90", 2, 0.9)):
        want = expected(skewed, col, q)
        for r in got:
            assert (r[name] is None) == (want[r["k"]] is None)
            if r[name] is not None:
                assert r[name] == pytest.approx(want[r["k"]], abs=1e-12)
    assert {r["k"]: r["n"] for r in got} == {0: 4000, 1: 37, 2: 1, 3: 900, 4: 2}


def test_group_quantiles_global_and_probe(spark, skewed):
    df = frame(spark, skewed, "k int, v double, w double")
    v = [r[1] for r in skewed]
    for limit in (10 ** 9, 100):
        got = group_quantiles(df, [], {"q": ("v", 0.37)}, limit=limit).collect()
        assert len(got) == 1 and got[0]["q"] == pytest.approx(np.quantile(v, 0.37), abs=1e-12)
    parts = df.withColumn("half", F.col("v") > 10)
    got = group_quantiles(parts, ["k", "half"], {"q": ("v", 0.5)}, limit=500, probe=df, probe_keys=["k"])
    want = {}
    for r in skewed:
        want.setdefault((r[0], r[1] > 10), []).append(r[1])
    assert {(r["k"], r["half"]): r["q"] for r in got.collect()} == pytest.approx(
        {k: float(np.median(x)) for k, x in want.items()})


def test_hot_groups_are_listed(spark, skewed):
    rows, biggest = hot_groups(frame(spark, skewed, "k int, v double, w double"), ["k"], 500)
    assert sorted(r["k"] for r in rows) == [0, 3] and biggest == 4000


def test_median_is_exact_at_every_size(spark):
    rng = np.random.default_rng(5)
    sets = {i: np.round(rng.standard_cauchy(n), 3) for i, n in enumerate((1, 2, 63, 64, 65, 90, 300, 1000))}
    sets[20] = np.full(200, 3.5)
    df = frame(spark, [(k, float(x)) for k, v in sets.items() for x in v] + [(30, None)], "k int, v double")
    for out in (counted_median(df, ["k"], "v"), counted_median(df, ["k"], "v", limit=80)):
        got = {r["k"]: (r["median"], r["n"]) for r in out.collect()}
        assert {k: m for k, (m, _) in got.items()} == pytest.approx({k: float(np.median(v)) for k, v in sets.items()}, abs=1e-12)
        assert {k: n for k, (_, n) in got.items()} == {k: len(v) for k, v in sets.items()}


def test_numbered_is_dense_and_ordered(spark):
    df = spark.range(0, 5000, numPartitions=7).withColumn("g", F.pmod(F.xxhash64("id"), F.lit(3)))
    out = numbered(df, ["g", F.desc("id")]).collect()
    assert sorted(r["ord"] for r in out) == list(range(5000))
    by = sorted(out, key=lambda r: r["ord"])
    assert [(r["g"], -r["id"]) for r in by] == sorted((r["g"], -r["id"]) for r in by)
    copies = numbered(spark.range(1000).select(F.lit(1).alias("x")), ["x"]).collect()
    assert sorted(r["ord"] for r in copies) == list(range(1000))
    assert numbered(spark.range(0), ["id"]).collect() == []


def test_subset_is_exact(spark):
    df = spark.range(10_000)
    ids = [r["id"] for r in subset(df, 777, "id").collect()]
    assert len(ids) == len(set(ids)) == 777
    assert max(ids) > 9000 and sorted(ids) == sorted(r["id"] for r in subset(df, 777, "id").collect())
    assert subset(df, 20_000, "id").count() == 10_000
    assert set(ids) <= {r["id"] for r in subset(df, 900, "id").collect()}        # a larger subset contains it


def test_splits(spark):
    chips = spark.range(100).withColumnRenamed("id", "chip")
    got = {r["chip"] for r in split_chips(chips).where("val").collect()}
    by_hash = chips.orderBy(portable_hash(F.col("chip"), 42), "chip").limit(20)
    assert got == {r["chip"] for r in by_hash.collect()}
    odd = spark.range(99).withColumnRenamed("id", "chip")
    assert split_chips(odd, 0.25, how="shuffle").where("val").count() == 24
    assert split_chips(odd, 0.25).where("val").count() == 25
    n = row_split(spark.range(50_000), "id").where("test").count()
    assert abs(n - 10_000) < 500


def test_every_nth_and_top_k(spark):
    df = spark.range(50).withColumn("g", F.col("id") % 4)
    assert sorted(r["id"] for r in every_nth(df, ["id"], 7).collect()) == list(range(0, 50, 7))
    top = top_k(df, ["g"], [F.desc("id")], 2).collect()
    assert sorted(r["id"] for r in top) == list(range(42, 50))


@pytest.mark.parametrize("distinct", [50, 5000])
def test_hot_null_keys(spark, distinct):
    """A NULL key is a group like others, split when it is hot."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), F.when(F.col("id") % 2 == 0, "x").alias("h"),
                                  (F.col("id") * 7919 % distinct).cast("double").alias("v"))
    rows = df.collect()
    for limit in (10_000, 1000, 100):
        got = {(r["k"], r["h"]): (r["q"], r["n"]) for r in group_quantiles(df, ["k", "h"], {"q": ("v", 0.3)}, [F.count(F.lit(1)).alias("n")], limit=limit).collect()}
        want = {}
        for key in {(r["k"], r["h"]) for r in rows}:
            values = [r["v"] for r in rows if (r["k"], r["h"]) == key]
            want[key] = (pytest.approx(np.percentile(values, 30)), len(values))
        assert got == want and (None, None) in got
