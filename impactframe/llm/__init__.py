"""Operators for preparing code and text as language-model training data."""
