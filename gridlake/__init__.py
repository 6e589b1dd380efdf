"""Spark-native analytics for gridded cell-by-year tables."""
