"""Corpus preparation operators for large-scale training data."""
