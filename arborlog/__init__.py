"""A PySpark-native engine for append-only logs of symbol operations."""
