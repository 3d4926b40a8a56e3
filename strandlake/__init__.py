"""Spark-native exact and approximate sequence search."""
