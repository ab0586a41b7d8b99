"""Spark-native analytics for content-addressed, deduplicated file repositories."""
