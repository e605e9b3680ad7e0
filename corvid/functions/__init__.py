"""Column expressions: paths, text, vectors."""
