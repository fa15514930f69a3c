"""Column expressions and schema helpers."""
