"""Spark-native analytics over time-ordered observations and training corpora."""
