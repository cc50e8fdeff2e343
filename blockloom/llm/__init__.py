"""Operators of a training-data pipeline: mixing, deduplication, filters, scans and token output."""
