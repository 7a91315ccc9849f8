"""Column functions: text, address parsing, scores, codes, geometry and records."""
