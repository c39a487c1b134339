"""A PySpark-native engine for the data semantics of a distributed key-value cache."""
