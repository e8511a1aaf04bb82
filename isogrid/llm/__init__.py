"""Operators for large text corpora (training-data preparation). Nothing else in the library imports this package."""
