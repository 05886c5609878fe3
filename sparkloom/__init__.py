"""Spark-native preparation, search and measurement of text knowledge bases."""
