"""Whole plans: the preparation pipeline, and the catalogue of queries over the driver's tables."""
