"""Spark-native indexing, retrieval and evaluation over hierarchical documents."""

__version__ = "0.1.0"
