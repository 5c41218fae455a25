"""Column functions: text analysis and vectors."""
