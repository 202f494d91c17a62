"""Operators for large training-data corpora: deduplication, filtering, privacy, tokens."""
