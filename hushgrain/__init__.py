"""Spark-native text de-identification and re-identification-risk engine."""
