"""Spark-native panel analytics: observation tables to season dates, panels and effects."""

__version__ = "0.1.0"
