"""Spark-native deduplication, storage analytics and change tracking."""
