"""Column functions: coercion, scoring, comparison, JSON repair."""
