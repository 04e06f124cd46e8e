"""Operators on texts for training data. Nothing else in tidemark imports this package."""
