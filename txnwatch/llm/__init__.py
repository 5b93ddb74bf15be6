"""Operators of a training-data pipeline: packing, deduplication, token counts, filters, search, sharding."""
