"""Versioned trees, commit graphs and merges as Spark DataFrames."""
