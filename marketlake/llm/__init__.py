"""Operators for preparing training data: mixing, deduplication, archives, tokens, scoring, embeddings."""
