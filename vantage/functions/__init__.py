"""Column expressions: addresses, text and times."""
