"""papyrine: Spark-native preparation, indexing and search of structured article collections."""

__version__ = "0.1.0"
