"""Column expressions and the fixed rule values."""
