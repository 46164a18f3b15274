"""Operators of a training-data pipeline: filtering, deduplication, tokenization, scoring, packing."""
