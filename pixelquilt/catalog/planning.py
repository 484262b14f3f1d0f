"""Cell plans, download jobs and cost estimates, samples and orders."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.sampling import every_nth, row_split, split_chips, subset, top_k
from ..operators.spatial import cells_in_area
from ..plans import cells as C
from ..plans import downloads as D
from ..scale import numbered
from ..session import stash
from .base import CELLS, OBS, R, SCENE, Tables, big, query, rnd
from .spatial import GX, GY, area_cells_sql, study_edges

REACH = 20000.0
WATER_SQL = "(SELECT s_suppkey AS k, abs(s_acctbal) / 10000 AS water FROM supplier)"
PLAN_SQL = f"""(SELECT a.*, w.water FROM {area_cells_sql(REACH)} a LEFT JOIN {WATER_SQL} w ON w.k = ((col + 50) * 37 + (row + 50) * 11) % 100)"""


def _area(t: Tables) -> DataFrame:
    """Candidate cells with a water share looked up in the supplier table (the first hundred rows, one is missing
    wherever the table is shorter)."""
    water = t.read("supplier").select(F.col("s_suppkey").alias("k"), (F.abs("s_acctbal") / 10000).alias("water"))
    cells = cells_in_area(study_edges(t), GX, GY, REACH)
    return (cells.withColumn("k", ((F.col("col") + 50) * 37 + (F.col("row") + 50) * 11) % 100)
            .join(water, "k", "left").drop("k"))


TARGET, WMAX = 150, 0.6
RING_SQL = f"""(SELECT (SELECT count(*) FROM {PLAN_SQL} WHERE area >= 1) AS n_aoi,
 (SELECT coalesce(min(d), 20000) FROM (SELECT least(k * 1000.0, 20000) AS d FROM range(0, 21) q(k)) s WHERE
   (SELECT count(*) FROM {PLAN_SQL} p WHERE area >= 1 OR (round_even(p.dist, 0) <= s.d AND NOT coalesce(water >= {WMAX}, false))) >= {TARGET}) AS d)"""


@query("G1 I5", f"""SELECT n_aoi, CAST(d AS DOUBLE) AS ring_m, (SELECT count(*) FROM {PLAN_SQL} WHERE area >= 1 OR (round_even(dist, 0) <= d AND NOT coalesce(water >= {WMAX}, false))) AS usable FROM {RING_SQL}""")
def training_ring(t: Tables):
    return C.ring_distance(stash(_area(t)), TARGET, 20.0, WMAX).select(
        big("n_aoi")[0], F.col("D").cast("double").alias("ring_m"), big("usable")[0])


FULL_PLAN_SQL = f"""(SELECT cell, x0, y1, col, row, CASE WHEN area >= 1 THEN 'aoi' ELSE 'ring' END AS role,
 CASE WHEN area >= 1 THEN 0 ELSE CAST(round_even(dist, 0) AS INT) END AS dist_m, water, area >= 1 OR NOT coalesce(water >= {WMAX}, false) AS use
 FROM {PLAN_SQL}, {RING_SQL} WHERE area >= 1 OR round_even(dist, 0) <= d)"""


@query("G1 H1 A13", f"""SELECT row_number() OVER (ORDER BY CASE WHEN role = 'aoi' THEN 0 ELSE 1 END, dist_m, y1 DESC, x0) - 1 AS ord,
 cell, role, dist_m, {R('water')} AS water, use FROM {FULL_PLAN_SQL}""")
def training_plan(t: Tables):
    plan = C.plan_cells(_area(t), TARGET, 20.0, WMAX)
    return numbered(plan, C.plan_order()).select(big("ord")[0], "cell", "role", "dist_m", rnd(F.col("water")).alias("water"), "use")


@query("G1b", f"SELECT cell, 'aoi' AS role, 0 AS dist_m, CAST(NULL AS DOUBLE) AS water, true AS use FROM {PLAN_SQL} WHERE area >= 1")
def area_only_plan(t: Tables):
    return C.area_only_plan(_area(t)).select("cell", "role", "dist_m", "water", "use")


@query("E30 B20", f"""SELECT pos, category, count(role) AS n FROM (VALUES (0, 'aoi'), (1, 'ring'), (2, 'dropped (water)')) v(pos, category)
 LEFT JOIN (SELECT role, CASE WHEN role = 'aoi' THEN 'aoi' WHEN use THEN 'ring' ELSE 'dropped (water)' END AS category FROM {FULL_PLAN_SQL}) USING (category) GROUP BY ALL""")
def cell_categories(t: Tables):
    return C.category_counts(C.plan_cells(_area(t), TARGET, 20.0, WMAX)).select(F.col("pos").cast("int").alias("pos"), "category", "n")


# a layer of a cell is there if the newest of its rows says so
NEWEST = "(SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_shipdate DESC, l_orderkey DESC) = 1)"
EXISTING_SQL = f"""(SELECT l_suppkey AS cell, CASE l_linenumber WHEN 1 THEN 'Embedding' WHEN 2 THEN 'S1' WHEN 3 THEN 'S2' WHEN 4 THEN 'DEM'
 WHEN 5 THEN 'GEDI' WHEN 6 THEN 'Tolan_1m' ELSE 'ETH' END AS layer FROM {NEWEST} WHERE l_quantity <= 25)"""
JOB_CELLS_SQL = f"(SELECT ord AS cell, CASE WHEN col < 4 THEN 'aoi' ELSE 'ring' END AS role, water < 0.9 AS use FROM {CELLS})"
MISSING_SQL = f"""(SELECT c.cell, c.role, w.layer FROM {JOB_CELLS_SQL} c
 JOIN (SELECT unnest(['Embedding', 'DEM', 'S1', 'S2', 'GEDI', 'Tolan_1m', 'UMD', 'ETH']) AS layer) w
 ON c.role = 'aoi' OR w.layer NOT IN ('Tolan_1m', 'UMD', 'ETH') ANTI JOIN {EXISTING_SQL} e ON e.cell = c.cell AND e.layer = w.layer)"""


def newest(t: Tables) -> DataFrame:
    """cell, line, quantity: the newest row of every cell and line number."""
    last = F.struct("l_shipdate", "l_orderkey")
    return (t.read("lineitem").groupBy(F.col("l_suppkey").alias("cell"), F.col("l_linenumber").alias("line"))
            .agg(F.max_by("l_quantity", last).alias("quantity")))


def _existing(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("Embedding", "S1", "S2", "DEM", "GEDI", "Tolan_1m", "ETH")])
    return newest(t).where("quantity <= 25").select("cell", names[F.least("line", F.lit(7)) - 1].alias("layer"))


def _missing(t: Tables) -> DataFrame:
    cells = t.cells.select(F.col("ord").alias("cell"), F.when(F.col("col") < 4, "aoi").otherwise("ring").alias("role"))
    return D.missing_layers(cells, _existing(t), "AE", ["GMTCH", "GFCH", "HRCH"])


JOBS_SQL = f"""(SELECT cell, CASE WHEN layer IN ('DEM', 'GEDI') THEN 'DEM+GEDI' ELSE layer END AS bundle, string_agg(layer, ',' ORDER BY layer) AS layers,
 count(*) AS k FROM {MISSING_SQL} GROUP BY ALL)"""


@query("C11 I4", f"SELECT cell, bundle, layers FROM {JOBS_SQL}")
def download_jobs(t: Tables):
    return D.jobs(_missing(t)).select("cell", "bundle", F.concat_ws(",", "layers").alias("layers"))


@query("C11 E20", f"""SELECT count(*) AS jobs, CAST(sum(CASE WHEN bundle = 'S1' THEN 3 WHEN k = 2 THEN 2 ELSE 3 END)
 + 2 + floor(count(CASE WHEN bundle = 'S1' THEN 1 END) / 50) AS BIGINT) AS requests FROM {JOBS_SQL}""")
def download_requests(t: Tables):
    return D.requests(D.jobs(_missing(t))).select("jobs", "requests")


_COST = ", ".join(f"('{k}', {v[0]}, {v[1]}, {v[2]}, {v[3]}, {D.TRANSFER_MB.get(k, 0.0)})" for k, v in D.COST_LOCAL.items())


@query("E20", f"""SELECT layer, count(*) AS files, {R('sum(mb)', 3)} AS mb, {R('sum(tr)', 3)} AS transfer_mb, {R('sum(s)', 3)} AS eecu_s, {R('sum(lo)', 3)} AS eecu_s_low,
 {R('sum(hi)', 3)} AS eecu_s_high FROM {MISSING_SQL} JOIN (VALUES {_COST}) v(layer, mb, s, lo, hi, tr) USING (layer) GROUP BY ROLLUP (layer)""")
def download_estimate(t: Tables):
    return D.estimate(_missing(t)).select("layer", "files", *[rnd(F.col(c), 3).alias(c) for c in (
        "mb", "transfer_mb", "eecu_s", "eecu_s_low", "eecu_s_high")])


@query("E20", f"SELECT count(*) AS cells, count(CASE WHEN role = 'aoi' THEN 1 END) AS aoi_cells, count(CASE WHEN role = 'ring' THEN 1 END) AS ring_cells FROM {JOB_CELLS_SQL}")
def role_counts(t: Tables):
    return D.role_counts(t.cells.withColumn("role", F.when(F.col("col") < 4, "aoi").otherwise("ring")))


@query("E21", f"""SELECT count(CASE WHEN use THEN 1 END) AS cells, {R('count(CASE WHEN use THEN 1 END) * (26.0 + 0.02 + 0.9 + 0.82 + 0.02 + 10.0 + 0.26) / 1e3 + least(2000000, 870 * count(CASE WHEN use THEN 1 END)) * 11.0 / 1e6 + 0.6')} AS gb FROM {JOB_CELLS_SQL}""")
def storage_estimate(t: Tables):
    return D.storage_estimate(t.cells.withColumn("use", F.col("water") < 0.9)).select("cells", rnd(F.col("gb")).alias("gb"))


@query("C12 X13", """SELECT c_custkey AS cell, layer, concat_ws(', ', CASE WHEN layer = 'S1' AND c_nationkey % 5 = 0 THEN 'year 2019' END,
 CASE WHEN layer = 'GEDI' AND c_nationkey % 7 = 0 THEN 'gedi_start 2018-01-01' END, CASE WHEN layer = 'GEDI' AND c_custkey % 9 = 0 THEN 'built_up_mask False' END) AS reason
 FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN 'S1' ELSE 'GEDI' END AS layer FROM customer) WHERE reason <> ''""")
def settings_mismatches(t: Tables):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    tags = F.create_map(F.lit("year"), F.when(n % 5 == 0, " 2019 ").when(n % 5 == 1, " ").otherwise("2020"),
                        F.lit("gedi_start"), F.when(n % 7 == 0, "2018-01-01").otherwise("2019-01-01"),
                        F.lit("built_up_mask"), F.when(k % 9 == 0, "False").otherwise("True"))
    have = t.read("customer").select(k.alias("cell"), F.when(k % 2 == 0, "S1").otherwise("GEDI").alias("layer"), tags.alias("tags"))
    return D.settings_mismatch(have, 2020, ("2019-01-01", "2021-12-31"), True)


@query("H2 H3 E32", f"SELECT sid, orbit, t FROM (SELECT sid, orbit, t, row_number() OVER (PARTITION BY orbit ORDER BY t DESC, sid) AS rn FROM {SCENE}) WHERE rn <= 5")
def latest_scenes(t: Tables):
    return top_k(t.scene.select("sid", "orbit", "t"), ["orbit"], [F.desc("t"), "sid"], 5)


@query("G6 I2", f"""SELECT orbit, string_agg(strftime(d, '%Y-%m-%d'), ',' ORDER BY d DESC) AS dates FROM (SELECT orbit, CAST(t AS DATE) AS d,
 dense_rank() OVER (PARTITION BY orbit ORDER BY CAST(t AS DATE) DESC) AS k FROM (SELECT DISTINCT orbit, t FROM {SCENE})) WHERE k <= 10 GROUP BY orbit""")
def newest_dates(t: Tables):
    days = t.scene.select("orbit", F.to_date("t").alias("d")).distinct()
    newest = top_k(days, ["orbit"], [F.desc("d")], 10)
    # ten dates per orbit
    return newest.groupBy("orbit").agg(F.concat_ws(",", F.transform(
        F.sort_array(F.collect_list("d"), asc=False), lambda d: F.date_format(d, "yyyy-MM-dd"))).alias("dates"))


HASH_SQL = """((((k % 2147483647) * 1103515245 + {seed} * 12345 + 1013904223) % 2147483648 >> 8) * 22695477
 + ((k % 2147483647) * 1103515245 + {seed} * 12345 + 1013904223) % 2147483648 + 1) % 2147483648"""


@query("H4", f"SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {HASH_SQL.format(seed=42)}, k) AS i FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)) WHERE i <= 1234")
def row_subset(t: Tables):
    return subset(t.read("orders").select("o_orderkey"), 1234, "o_orderkey")


@query("H6", f"SELECT test, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT k, {HASH_SQL.format(seed=42)} < 429496729 AS test FROM (SELECT o_orderkey AS k FROM orders)) GROUP BY test")
def hashed_split(t: Tables):
    out = row_split(t.read("orders"), "o_orderkey")
    return out.groupBy("test").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("total"))


@query("H5", f"""SELECT k AS chip, row_number() OVER (ORDER BY {HASH_SQL.format(seed=42)}, k) <= ceil(0.2::DOUBLE * count(*) OVER ()) AS val
 FROM (SELECT c_custkey AS k FROM customer)""")
def chip_split(t: Tables):
    return split_chips(t.read("customer").select(F.col("c_custkey").alias("chip")))


@query("H7", f"SELECT sid FROM (SELECT sid, row_number() OVER (ORDER BY t, sid) - 1 AS i FROM {SCENE}) WHERE i % 7 = 0")
def every_seventh_scene(t: Tables):
    return every_nth(t.scene.select("sid", "t"), ["t", "sid"], 7).select("sid")


@query("G2 H2", f"SELECT sid, row_number() OVER (ORDER BY t, sid) - 1 AS ord FROM {SCENE}")
def scene_order(t: Tables):
    return numbered(t.scene.select("sid", "t"), ["t", "sid"]).select("sid", big("ord")[0])


@query("I1 I3 I4", f"""SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)
 UNION ALL SELECT 'only', count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)
 UNION ALL SELECT 'dates', count(*) FROM (SELECT CAST(t AS DATE) FROM {SCENE} WHERE pol = 'P' AND cloud > 95 UNION SELECT CAST(t AS DATE) FROM {OBS} WHERE b1 = 50 AND aux = 0.08)""")
def set_operations(t: Tables):
    sup = t.read("supplier").where("s_acctbal > 8000").select(F.col("s_nationkey").alias("k"))
    both = t.read("customer").select(F.col("c_nationkey").alias("k")).intersect(sup)
    only = t.read("nation").select(F.col("n_nationkey").alias("k")).subtract(sup)
    dates = t.scene.where("pol = 'P' AND cloud > 95").select(F.to_date("t").alias("d")).union(
        t.obs.where("b1 = 50 AND aux = 0.08D").select(F.to_date("t").alias("d"))).distinct()
    count = F.count(F.lit(1)).alias("n")
    return (both.agg(F.lit("both").alias("kind"), count).unionByName(only.agg(F.lit("only").alias("kind"), count))
            .unionByName(dates.agg(F.lit("dates").alias("kind"), count)))
