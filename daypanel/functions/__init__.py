"""Column expressions: casting, quality flags, derived variables, value rules."""
