"""Spark-native analytics over large collections of numerical experiment runs."""

__version__ = "0.1.0"
