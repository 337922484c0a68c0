"""Operators for pipelines of training data; nothing else in the package imports them."""
