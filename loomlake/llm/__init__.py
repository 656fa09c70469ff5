"""Operators for text and algorithm problems of large training-data pipelines."""
