"""Tessera: a Spark-native engine for post-training data and evaluation analytics."""

__version__ = "0.1.0"
