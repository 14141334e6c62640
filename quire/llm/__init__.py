"""Operators for training-data problems; nothing else in the library imports this package."""
