"""Column expressions: dates, filing text, hashing, vectors, messages."""
