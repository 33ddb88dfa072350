"""quarry: a PySpark-native fielded search and text-data engine."""
