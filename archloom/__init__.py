"""Spark-native analytics over declaration graphs."""
