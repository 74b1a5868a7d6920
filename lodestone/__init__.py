"""Spark-native hybrid text search and analytics."""
