"""Spark-native scanning of text corpora for prompt injection."""

__version__ = "0.1.0"
