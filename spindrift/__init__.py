"""Spark-native similarity search and retrieval analytics."""
