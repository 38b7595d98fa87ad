"""Spatial reading and querying on Spark DataFrames."""
