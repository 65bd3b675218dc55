"""A Spark-native engine for log analytics."""

__version__ = "0.1.0"
