"""Operators for training data in large text collections. Nothing outside this package imports it."""
