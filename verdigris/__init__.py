"""A PySpark-native engine for document catalogues, provenance and retrieval."""
