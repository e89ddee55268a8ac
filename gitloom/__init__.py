"""Spark-native analytics over version-control history."""

__version__ = "0.1.0"
