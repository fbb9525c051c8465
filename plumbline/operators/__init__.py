"""Operators: each takes DataFrames and returns DataFrames, without actions of its own."""
