"""Operators of a training-data pipeline: tokenising, filtering, near-duplicates, packing, scoring, search."""
