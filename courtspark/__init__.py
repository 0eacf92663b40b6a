"""Spark-native analytics over sports-tracking tables."""
