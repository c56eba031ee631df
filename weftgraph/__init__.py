"""Spark-native graph analytics: edge lists and matrices in, graph statistics, orderings and embeddings out."""
