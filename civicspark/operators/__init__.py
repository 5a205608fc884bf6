"""Relational and set-oriented operators on DataFrames."""
