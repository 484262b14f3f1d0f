"""Grid analytics on Spark: pixels, scene observations, grid cells and labels as DataFrames."""
