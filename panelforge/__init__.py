"""Spark-first engine for point-in-time news and returns panels."""

__version__ = "0.1.0"
