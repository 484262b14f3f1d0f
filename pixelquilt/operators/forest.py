"""Random forest on labelled pixels (Spark ML)."""
from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from ..functions.encode import assemble, forest_features
from ..schema import REPRESENTATIONS, canonical
from .metrics import flat_accuracy
from .sampling import row_split, subset

# Spark ML trees are at most 30 deep; the other values follow the published recipe of the model
DEFAULTS = dict(numTrees=600, maxDepth=30, minInstancesPerNode=4, featureSubsetStrategy="sqrt", seed=42)


def features(px: DataFrame, representation: str = "AE", encoding: str = "paper") -> DataFrame:
    """Feature vector of pixels (annual[, seasonal])."""
    rep = canonical(representation)
    seasonal = F.col("seasonal") if REPRESENTATIONS[rep]["seasonal"] else None
    x = forest_features(assemble(rep, F.col("annual"), seasonal), encoding, REPRESENTATIONS[rep]["n_embed"])
    return px.withColumn("features", array_to_vector(F.transform(x, lambda v: v.cast("double"))))


def training_rows(px: DataFrame, key: str = "id", max_rows: int | None = None, seed: int = 42) -> DataFrame:
    """Pixels with a label > 0, optionally a fixed-size subset, split 80 / 20 (column test)."""
    rows = px.where("label > 0")
    if max_rows:
        rows = subset(rows, max_rows, key, seed)
    return row_split(rows, key, 0.2, seed)


def train_forest(rows: DataFrame, **params) -> tuple[RandomForestRegressionModel, DataFrame]:
    """(model, hold-out accuracy) from rows (features, label, test)."""
    model = RandomForestRegressor(featuresCol="features", labelCol="label", predictionCol="pred",
                                  **{**DEFAULTS, **params}).fit(rows.where("NOT test"))
    scored = model.transform(rows.where("test"))
    return model, flat_accuracy(scored, ref="label")


def forest_map(model: RandomForestRegressionModel, px: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """(r, c, p) of the masked pixels with data: pixels outside the mask and all-zero pixels are not scored."""
    kept = px if mask is None else px.join(mask.select("r", "c").distinct(), ["r", "c"], "left_semi")
    return (model.transform(kept.where(~F.forall("annual", lambda b: b == 0)))
            .select("r", "c", F.col("pred").alias("p")))
