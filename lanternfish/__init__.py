"""Spark-native retrieval analytics."""
