"""Spark-native cross-sectional scoring and validation operators."""
