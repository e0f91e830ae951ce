"""Column expressions: text, paths, vectors and sets."""
