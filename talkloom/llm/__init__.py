"""Operators of a training-data pipeline: filters, scores, near duplicates, mixing, shards, records, media and token counts."""
