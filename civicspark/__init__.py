"""Spark-native analytics for corpora of public-council documents."""

__version__ = "0.1.0"
