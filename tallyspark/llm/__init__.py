"""Operators for training corpora, one module each; ``queries`` registers them.
Nothing else in the library imports this package."""
