"""Lodestone: a Spark-native engine for retrieval, knowledge-graph and language-model-operations data."""

__version__ = "0.1.0"
