"""Operators of a training-data pipeline: filters, counts, mixing, joins, sharding, deduplication, fingerprints."""
