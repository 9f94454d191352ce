"""Operators on texts for training corpora; nothing else in the library imports this package."""
