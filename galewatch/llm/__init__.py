"""Operators for large-scale training-data pipelines, all on Spark DataFrames."""
