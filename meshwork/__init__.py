"""Spark-native analytics for three-dimensional structures and their networks."""
