"""Operators for large training-data pipelines over document tables."""
