"""Spark-native curation, audit, scoring-policy and evaluation queries over media-moderation tables."""
