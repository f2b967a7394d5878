"""Readers and writers for the supported file layouts."""
