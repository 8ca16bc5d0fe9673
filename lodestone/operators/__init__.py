"""Relational operators of the engine; every one is a function from DataFrames to a DataFrame."""
