"""Column functions: text analysis, cleaning, statistics."""
