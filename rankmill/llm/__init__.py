"""Operators for training-data pipelines over text documents; nothing else in the library imports this."""
