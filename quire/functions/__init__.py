"""Column functions: text, patterns, hashes, arrays."""
