"""Spark-native vector analytics and machine learning."""
