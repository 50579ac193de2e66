"""A PySpark-native document-analytics and hybrid-retrieval engine."""
