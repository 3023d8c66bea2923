"""Spark-native analytics over labelled text records."""
