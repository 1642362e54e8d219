"""Operators for training-data work on texts. Nothing outside this package imports it."""
