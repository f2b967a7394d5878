"""Bindings of the operators to the driver tables, with their SQL checks."""
