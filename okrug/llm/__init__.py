"""Operators for texts and model-oriented matching; nothing else in the library imports this package."""
