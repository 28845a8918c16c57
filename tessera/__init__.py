"""Spark-native hybrid retrieval, ingest and evaluation engine."""
