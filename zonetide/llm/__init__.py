"""Operators over training text; nothing else in the package imports them."""
