"""Operators that prepare text collections for training; nothing outside this package imports it."""
