"""Operators for preparing training data, each by its own method. Nothing else in the library imports them."""
