"""A PySpark-native engine for the query model of classic xBase databases."""
