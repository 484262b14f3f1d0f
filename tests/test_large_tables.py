"""What large tables need: no broadcast of rows that multiplied, no shuffle more than the step asks for, alike work done once."""
import re

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def broadcast_parts(df) -> list[str]:
    """The plan text below every broadcast exchange."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [re.search(r"[A-Za-z]", line).start() if re.search(r"[A-Za-z]", line) else 0 for line in lines]
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out.append("\n".join(lines[i + 1:end]))
    return out


@pytest.mark.parametrize("name", ["scenes_on_cells", "raw_scene_decibels"])
def test_scene_pixels_are_never_broadcast(spark, name):
    """Their number does not show in the size of the table that they are made of."""
    for part in broadcast_parts(entry.queries()[name](spark, FOLDER)):
        assert "Window" not in part and part.count("Generate explode") < 2, part


@pytest.mark.parametrize("name", ["member_sums", "acquisition_decibels"])
def test_scene_pixels_stay_in_their_block(spark, name):
    """The raster is dealt out once, before it becomes a row an acquisition; no exchange or broadcast holds those rows."""
    text = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    above = text[:text.index("Generate explode(Subquery")]
    assert "Exchange" not in above and "Join" not in above


def test_cell_corners_far_down_the_plan(spark, tmp_path):
    """The ring of a cell lies where the plan puts it, whatever row that is."""
    keys = spark.createDataFrame([(k, "s", 1, 2000.0) for k in (0, 1330, 5999, 59999)], "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")
    keys.write.parquet(f"{tmp_path}/supplier.parquet")
    rows = entry.queries()["cell_features"](spark, str(tmp_path)).collect()
    assert len(rows) == 4 and all(r["near"] and r["closed"] for r in rows)


@pytest.mark.parametrize("name", ["validation_scores", "validation_scores_by_recipe"])
def test_predictions_are_not_shuffled_by_model(spark, name):
    """What follows the rows of every model is the join with the labels, on the keys that they have."""
    text = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    above = text[:text.index("Generate explode([m1")].splitlines()
    chain = [line for line in above[max(i for i, line in enumerate(above) if "Join [chip" in line and "Inner" in line):]]
    assert not any("Exchange" in line for line in chain)
