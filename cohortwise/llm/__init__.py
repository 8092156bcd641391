"""Operators of a training-data pipeline: dedup, filters, mixing, packing, search."""
