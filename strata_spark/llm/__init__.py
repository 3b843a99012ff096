"""Operators for training data, each by its own method; their queries are in ``queries``."""
