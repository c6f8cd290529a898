"""Spark-native analytics and retrieval over project knowledge."""
