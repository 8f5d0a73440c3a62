"""Joins, windows, rankings, samples and aggregates over DataFrames."""
