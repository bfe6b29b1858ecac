"""Column functions: time, text, rounding, URLs, hashing."""
