"""Spark-native analytics over source-code graphs and text corpora."""
