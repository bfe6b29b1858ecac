"""Spark-native analytics over exam content, monitoring, usage and operations data."""
