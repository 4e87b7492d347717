"""Import-graph analysis on Spark DataFrames, with operators for training-data pipelines beside it."""
