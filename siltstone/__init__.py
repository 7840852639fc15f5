"""siltstone: a Spark-native analytics engine for text and code corpora."""

__version__ = "0.1.0"
