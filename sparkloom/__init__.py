"""A PySpark-native engine for exploring and reshaping semi-structured data."""
