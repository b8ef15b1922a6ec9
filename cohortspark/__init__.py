"""Spark-native gene-based association analytics."""
