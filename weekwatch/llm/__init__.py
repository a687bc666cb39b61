"""Operators of a training-data pipeline over documents, labels and embeddings."""
