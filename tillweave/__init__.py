"""Spark-native receipt extraction and spending analytics."""
