"""Column expressions and schema rules."""
