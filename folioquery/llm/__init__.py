"""Operators that turn a corpus into training data. Nothing else in the library imports this package."""
