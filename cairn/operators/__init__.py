"""Operators of the memory store, each a function from DataFrames to a DataFrame."""
