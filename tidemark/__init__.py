"""Tidemark: a Spark-native engine for bitemporal memory data."""
