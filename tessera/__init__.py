"""Spark-native document retrieval, grounded answering and evaluation."""
