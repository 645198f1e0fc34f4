"""Freshet: gridded shallow-water flood analytics on Spark DataFrames."""
