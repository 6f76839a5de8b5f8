"""PySpark-native full-text search and retrieval analytics."""

__version__ = "0.1.0"
