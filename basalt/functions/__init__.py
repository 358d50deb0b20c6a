"""Column expressions and row functions."""
