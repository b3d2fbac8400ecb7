"""Spark-native analytics over benchmark task sets, and training-data operators."""

__version__ = "0.1.0"
