"""Spark-native analytics over clinical case records: documents, timelines, features, similarity, retrieval."""
