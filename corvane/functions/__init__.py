"""Column expressions: text, hashing, statistics."""
