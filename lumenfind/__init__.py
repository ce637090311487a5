"""A PySpark-native document search and text-analytics engine."""

__version__ = "0.1.0"
