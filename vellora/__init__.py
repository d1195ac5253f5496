"""Spark-native engine for auditing structured documents and curating text at scale."""

__version__ = "0.1.0"
