"""Spark-native analytics for photo collections, their videos and their texts."""
