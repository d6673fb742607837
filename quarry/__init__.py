"""quarry: a Spark-native engine for searching and analysing catalogs of file metadata."""

__version__ = "0.1.0"
