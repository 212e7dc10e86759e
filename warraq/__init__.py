"""warraq: a PySpark-native engine for scholarly-document processing."""
