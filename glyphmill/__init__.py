"""Spark-native subword vocabulary analytics."""
