"""Operators of a training-data pipeline: filters, duplicates, personal data, shards and packing."""
