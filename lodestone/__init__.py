"""PySpark-native hybrid search and retrieval analytics."""
