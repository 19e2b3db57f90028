"""Spark-native analytics of function clones."""
