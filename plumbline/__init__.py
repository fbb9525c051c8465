"""Lineage analytics on Spark DataFrames."""
