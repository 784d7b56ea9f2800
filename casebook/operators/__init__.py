"""Operators over DataFrames; the ids in docstrings are those of SURVEY §2."""
