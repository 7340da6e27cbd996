"""Operators for language-model training data. Nothing outside imports this."""
