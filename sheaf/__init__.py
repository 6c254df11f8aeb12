"""Spark-native document search analytics."""
