"""Operators for large training-data pipelines, each on whole DataFrames."""
