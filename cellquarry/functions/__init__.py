"""Column expressions: text, numbers, units, arrays."""
