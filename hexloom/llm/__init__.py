"""Operators for training-data pipelines over text, conversations and vectors."""
