"""A PySpark-native engine that transforms packaged documents at scale."""

__version__ = "0.1.0"
