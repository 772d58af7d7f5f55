"""Spark-native engine for curating speech and text training data."""

__version__ = "0.1.0"
