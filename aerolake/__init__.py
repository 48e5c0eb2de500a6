"""Spark-native analytics for hourly air-quality series."""
