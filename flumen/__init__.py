"""Spark-native analytics of gridded, time-resolved vector fields."""
