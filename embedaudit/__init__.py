"""Spark-native audit of embedding stability, and of the cohorts behind it."""
