"""Operators on text, names and vectors for preparing training data."""
