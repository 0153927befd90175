"""Column expressions and random streams."""
