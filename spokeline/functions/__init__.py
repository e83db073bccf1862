"""Column expressions: geometry, number formats, dimension lookups."""
