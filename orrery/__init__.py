"""Orrery: a Spark-native analytics engine for text and event data."""
