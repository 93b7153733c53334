"""Column expressions: text, lexicons, vectors, dates and JSON."""
