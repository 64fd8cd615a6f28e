"""Operators for training-data pipelines over ``documents`` and its sister tables."""
