"""Whole plans: evaluation of a run, and the catalogue of queries over the driver's tables."""
