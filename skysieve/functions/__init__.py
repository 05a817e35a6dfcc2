"""Column expressions: numbers, labels, scores, policies."""
