"""Operators for training-data pipelines: filtering, deduplication, scoring, tokenising, packing."""
