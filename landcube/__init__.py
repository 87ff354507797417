"""A Spark-native engine for change detection on gridded, multi-temporal data."""
