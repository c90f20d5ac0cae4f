"""Operators for training-data pipelines, each with its named query."""
