"""Operators of a training-data pipeline: search, joins, deduplication, classifiers, tokenising, archives."""
