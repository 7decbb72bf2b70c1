"""Spark-native spreadsheet-style analytics and training-data operators."""
