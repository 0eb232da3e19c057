"""Sparse-volume analytics on Spark DataFrames."""
