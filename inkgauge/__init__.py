"""Spark-native analytics for text recognition and automated scoring."""
