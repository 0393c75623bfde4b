"""Operators for language-model training text; the rest of the library doesn't import this package."""
