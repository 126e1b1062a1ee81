"""Column functions: tokenising, normalising, hashing."""
