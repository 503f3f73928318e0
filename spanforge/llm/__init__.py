"""Operators for training texts. Nothing outside this package imports it."""
