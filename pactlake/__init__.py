"""Spark-native analysis of contract corpora."""
