"""Spark-native habitat analytics: DataFrame in, DataFrame out."""
