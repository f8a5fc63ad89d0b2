"""Operators on trees, histories and traces: DataFrames in, DataFrames out."""
