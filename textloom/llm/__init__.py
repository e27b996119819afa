"""Operators for preparing language-model training data. Nothing else in textloom imports this package."""
