"""Spark-native analytics over large collections of published text."""
