"""Spark-native analytics over knowledge graphs of lexical semantic change."""
