"""A PySpark-native engine for judgment analytics over large datasets."""
