"""Operators for preparing large training corpora; nothing else in segline imports this package."""
