"""Which layers are missing, what fetching them costs, what the project needs on disk."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import (BENCHMARK_LAYERS, LABEL_LAYER, REPRESENTATIONS, SEASONAL_LAYERS, canonical, needs_seasonal)

# ---- fixed values: rough cost of one cell and layer: (MB on disk, compute seconds, low, high, transfer MB) ----
_S1_SEASONAL = [k for k in SEASONAL_LAYERS if k.startswith("S1_asc")]
_S2_SEASONAL = [k for k in SEASONAL_LAYERS if k.startswith("S2_")]
COST_REMOTE = {
    "Embedding": (25.6, 5, 2.5, 10), "S1": (0.9, 150, 100, 3000), "S2": (0.8, 60, 30, 120), "DEM": (0.01, 1, 0.5, 2),
    "GEDI": (0.02, 5, 2.5, 10), "ETH": (0.02, 1, 0.5, 2), "UMD": (0.01, 1, 0.5, 2), "Tolan_1m": (1.2, 5, 2.5, 10),
    **{k: (0.9, 40, 25, 750) for k in _S1_SEASONAL}, **{k: (3.4, 20, 10, 40) for k in _S2_SEASONAL}}
COST_LOCAL = {**COST_REMOTE, "S1": (0.9, 10, 6, 60), **{k: (0.9, 3, 1.5, 15) for k in _S1_SEASONAL}}
TRANSFER_MB = {"S1": 50.0, **{k: 12.5 for k in _S1_SEASONAL}}
LAYER_MB = {"Embedding": 26.0, "S1": 0.9, "S2": 0.82, "DEM": 0.02, "GEDI": 0.02,
            **{k: 0.9 for k in _S1_SEASONAL}, **{k: 3.3 for k in _S2_SEASONAL}}
STACK_MB, LABEL_MB, SEASONAL_MB = 10.0, 0.26, 5.5
FOREST_KB_PER_PIXEL, FOREST_PIXELS_PER_CELL, FIXED_GB = 11.0, 870, 0.6
YEAR_LAYERS = ["Embedding", "S1", "S2", *SEASONAL_LAYERS]
BUNDLE = ["DEM", LABEL_LAYER]
# ----------------------------------------------------------------------------------------------------------------


def cell_layers(representation: str, benchmarks: list[str], role: Column) -> Column:
    """ARRAY of the file layers a cell needs; benchmark layers only for study-area cells."""
    base = list(dict.fromkeys([*REPRESENTATIONS[canonical(representation)]["layers"], *BUNDLE]))
    extra = [b if b == "GMTCH" else BENCHMARK_LAYERS[b] for b in benchmarks]
    inputs = F.array(*[F.lit(x) for x in base])
    return F.when(role == "aoi", F.concat(inputs, F.array(*[F.lit(x) for x in extra]).cast("array<string>"))) \
        .otherwise(inputs)


def missing_layers(cells: DataFrame, existing: DataFrame, representation: str, benchmarks: list[str]) -> DataFrame:
    """(cell, role, layer) to fetch. GMTCH is derived, so it stands for Tolan_1m while both are absent."""
    wanted = cells.select("cell", "role", F.explode(cell_layers(representation, benchmarks, F.col("role"))).alias("want"))
    have = existing.select("cell", F.col("layer").alias("want")).distinct()
    todo = wanted.join(have, ["cell", "want"], "left_anti")
    fetch = todo.withColumn("layer", F.when(F.col("want") == "GMTCH", "Tolan_1m").otherwise(F.col("want")))
    return fetch.select("cell", "role", "layer").join(existing.select("cell", "layer").distinct(),
                                                      ["cell", "layer"], "left_anti")


def jobs(missing: DataFrame, s1_method: str = "local") -> DataFrame:
    """(cell, bundle, layers): layers fetched together: elevation with labels, and the local seasonal radar."""
    seasonal = F.col("layer").isin(*_S1_SEASONAL) if s1_method == "local" else F.lit(False)
    key = (F.when(F.col("layer").isin(*BUNDLE), "+".join(BUNDLE)).when(seasonal, "S1_asc").otherwise(F.col("layer")))
    return missing.groupBy("cell", key.alias("bundle")).agg(
        F.sort_array(F.collect_set("layer")).alias("layers"))           # at most the layers of one bundle


def requests(job: DataFrame, s1_method: str = "local") -> DataFrame:
    """One row (jobs, requests): calls the jobs need. Local radar: 3 per cell plus the shared metadata; otherwise two
    per layer chunk, one for the band names of single layers and one for radar metadata."""
    first = F.element_at("layers", 1)
    radar = first.isin("S1", *_S1_SEASONAL)
    seasonal = first.isin(*_S1_SEASONAL)
    single = F.size("layers") == 1
    per = (F.when(radar & F.lit(s1_method == "local"), 3)
           .otherwise(2 + F.when(single, F.when(seasonal, 0).otherwise(1) + F.when(first == "S1", 1).otherwise(0))
                      .otherwise(0)))
    local = F.count_if(radar) if s1_method == "local" else F.lit(0)
    cells_with = (F.count_distinct(F.when(seasonal, F.col("cell"))) if s1_method == "gee" else F.lit(0))
    return job.agg(F.count(F.lit(1)).alias("jobs"),
                   (F.coalesce(F.sum(per), F.lit(0)) + cells_with
                    + F.when(local > 0, 2 + F.floor(local / 50)).otherwise(0)).cast("long").alias("requests"))


def cost_table(spark, s1_method: str = "local") -> DataFrame:
    cost = COST_LOCAL if s1_method == "local" else COST_REMOTE
    rows = [(k, float(mb), float(s), float(lo), float(hi), TRANSFER_MB.get(k, 0.0) if s1_method == "local" else 0.0)
            for k, (mb, s, lo, hi) in cost.items()]
    return spark.createDataFrame(rows, "layer string, mb double, eecu double, low double, high double, transfer double")


def estimate(missing: DataFrame, s1_method: str = "local") -> DataFrame:
    """Per layer and in total (layer NULL): files, MB, transfer and compute seconds (typical, low, high)."""
    costs = F.broadcast(cost_table(missing.sparkSession, s1_method))            # one row per known layer
    return missing.join(costs, "layer").rollup("layer").agg(
        F.count(F.lit(1)).alias("files"), F.sum("mb").alias("mb"), F.sum("transfer").alias("transfer_mb"),
        F.sum("eecu").alias("eecu_s"), F.sum("low").alias("eecu_s_low"), F.sum("high").alias("eecu_s_high"))


def role_counts(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("role") == "aoi").alias("aoi_cells"),
                     F.count_if(F.col("role") == "ring").alias("ring_cells"))


def storage_estimate(cells: DataFrame, representation: str = "AE", forest: bool = True,
                     max_rows: int = 2_000_000) -> DataFrame:
    """One row (cells, gb): expected size of the finished project."""
    rep = canonical(representation)
    mb = sum(LAYER_MB[x] for x in [*REPRESENTATIONS[rep]["layers"], LABEL_LAYER]) + STACK_MB + LABEL_MB \
        + (SEASONAL_MB if needs_seasonal(rep) else 0.0)
    n = F.count_if(F.col("use"))
    trees = F.least(F.lit(max_rows), FOREST_PIXELS_PER_CELL * n) * FOREST_KB_PER_PIXEL / 1e6 if forest else F.lit(0.0)
    return cells.agg(n.alias("cells"), (n * mb / 1e3 + trees + FIXED_GB).alias("gb"))


def settings_mismatch(existing: DataFrame, year: int, label_window: tuple, built_up_mask: bool) -> DataFrame:
    """(cell, layer, reason) of existing layers (cell, layer, tags MAP) made with other settings. Missing and empty
    tags are accepted."""
    wanted = {"year": str(year), "gedi_start": label_window[0], "gedi_end": label_window[1],
              "built_up_mask": str(bool(built_up_mask))}
    yearly = F.col("layer").isin(*YEAR_LAYERS)

    def wrong(tag: str, applies: Column) -> Column:
        got = F.trim(F.try_element_at("tags", F.lit(tag)))
        return F.when(applies & (got != "") & (got != wanted[tag]), F.concat(F.lit(f"{tag} "), got))
    label = F.col("layer") == LABEL_LAYER
    reason = F.concat_ws(", ", wrong("year", yearly), *[wrong(t, label) for t in list(wanted)[1:]])
    return existing.withColumn("reason", reason).where("reason <> ''").select("cell", "layer", "reason")


def require_settings(mismatch: DataFrame, shown: int = 20) -> None:
    """Stop when existing layers were made with other settings; the message shows the first cells."""
    cells = [r["cell"] for r in mismatch.select("cell").distinct().orderBy("cell").limit(shown + 1).collect()]
    if cells:
        more = ", ..." if len(cells) > shown else ""
        raise RuntimeError(f"layers made with other settings in cells {', '.join(cells[:shown])}{more}")
