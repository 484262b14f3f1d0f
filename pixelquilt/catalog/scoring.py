"""Model scoring."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators.forest import features, forest_map, train_forest, training_rows
from ..operators.tiles import score_chips
from .base import EMB, R, Tables, query, rnd
from .encodings import coded


def _linear(pdf: pd.DataFrame) -> pd.Series:
    x = np.vstack(pdf["bands"].to_numpy())
    return pd.Series(x @ (np.arange(x.shape[1]) / 64.0))


@query("F16 U2", f"""SELECT label AS chip, r, c, {R('sum(x * i / 64.0)', 5)} AS p FROM (SELECT label, r, c, unnest(range(0, 64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM {EMB}) GROUP BY ALL""")
def score_chip_batches(t: Tables):
    px = t.emb.select(F.col("label").cast("bigint").alias("chip"), "r", "c",
                      F.transform("embedding", lambda v: v.cast("double")).alias("bands"))
    return score_chips(px, _linear, batch=4).select(F.col("chip").cast("int").alias("chip"), "r", "c", rnd(F.col("p"), 5).alias("p"))


def _forest(t: Tables):
    px = features(coded(t), "AE", "paper").withColumn("label", F.col("label").cast("double"))
    return px, train_forest(training_rows(px), numTrees=8, maxDepth=6)


@query("F7 H6 E12")
def forest_accuracy(t: Tables):
    return _forest(t)[1][1]


@query("F6 B13")
def forest_prediction(t: Tables):
    px, (model, _) = _forest(t)
    return forest_map(model, px, px.where("label > 2").select("r", "c"))


@query("F6 F7", f"SELECT r, c, true AS within FROM {EMB} WHERE label > 2 AND len(list_filter(embedding, lambda x: x <> 0)) > 0")
def forest_scored_pixels(t: Tables):
    """Which pixels the forest scores, and that each score lies between the labels it was trained on."""
    px, (model, _) = _forest(t)
    lowest, highest = (px.where("label > 0").agg(f("label")).scalar() for f in (F.min, F.max))
    return forest_map(model, px, px.where("label > 2").select("r", "c")).select("r", "c", F.col("p").between(lowest, highest).alias("within"))
