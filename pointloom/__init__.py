"""Spark-native analytics for large valued point clouds."""
