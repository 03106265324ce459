"""Spark-first document structuring, chunking and training-data preparation."""
