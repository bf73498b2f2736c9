"""Granary: a deduplicating store's operators and a training-data pipeline on Spark."""
