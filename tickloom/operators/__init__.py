"""Operators on market data: pure functions from DataFrames to DataFrames. Arrival order is always a column, seq."""
