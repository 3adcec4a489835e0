"""Operators of a training-data pipeline: filters, near-duplicates, mixing, token counts, packing."""
