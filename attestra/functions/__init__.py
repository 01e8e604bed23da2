"""Column expressions: value, URL, text, hash, key and date functions."""
