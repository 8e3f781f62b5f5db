"""Column expressions: text, numbers, vectors."""
