"""A PySpark-native query and data-processing engine."""
