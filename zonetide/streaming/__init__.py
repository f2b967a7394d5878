"""Structured Streaming versions of the batch counts and joins."""
