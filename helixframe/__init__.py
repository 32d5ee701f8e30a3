"""A PySpark-native sequence-analytics engine."""
