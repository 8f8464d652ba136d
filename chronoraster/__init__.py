"""Spark-native analytics for satellite image time series."""
