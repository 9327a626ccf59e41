"""Spark-native engine for text-localisation data and training-data preparation."""
