"""Hybrid search, ranking and text-corpus processing on Spark DataFrames."""
