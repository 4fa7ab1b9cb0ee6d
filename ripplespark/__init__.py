"""A PySpark-native engine for change-impact questions over typed dependency graphs."""
