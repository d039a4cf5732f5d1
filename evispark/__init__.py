"""PySpark-native evidence analytics: text ETL, typed graph, vector retrieval, fusion and evaluation."""

__version__ = "0.1.0"
