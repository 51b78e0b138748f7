"""Operators for training-data pipelines: tokens, licences, quality, duplicates, leaks, search, PII."""
