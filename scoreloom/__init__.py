"""Spark-native scoring and comparison of language-model responses."""

__version__ = "0.1.0"
