"""Operators for training-data pipelines over texts, vectors and web pages."""
