"""Spark-first vector, late-interaction and corpus analytics."""

__version__ = "0.1.0"
