"""Prose analytics over Spark DataFrames."""
