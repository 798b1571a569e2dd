"""Operators of a training-data pipeline: filters, classifiers, deduplication, media and archives."""
