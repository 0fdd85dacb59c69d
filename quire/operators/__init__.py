"""Operators of scholarly document analytics, each a function from DataFrames to a DataFrame."""
