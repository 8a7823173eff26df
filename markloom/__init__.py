"""A Spark-native analytics engine for wiki markup and training-data tables."""

__version__ = "0.1.0"
