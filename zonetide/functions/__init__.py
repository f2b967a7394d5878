"""Column expressions: text, numbers, dates, geometry, ladders, statistics."""
