"""Column expressions: keys and names, text, numbers."""
