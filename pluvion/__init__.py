"""Spark-native analytics for gridded flood and drought monitoring tables."""
