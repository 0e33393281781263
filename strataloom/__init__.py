"""Spark-native analytics over source-code corpora and the documents, events and conversations around them."""
