"""Spark-native vector analytics: similarity search, codecs, loaders and data preparation on DataFrames."""

__version__ = "0.1.0"
