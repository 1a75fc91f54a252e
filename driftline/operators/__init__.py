"""Operators over histories: DataFrames in, DataFrames out."""
