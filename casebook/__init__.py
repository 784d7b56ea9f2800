"""Structured-extraction analytics on Spark DataFrames."""
