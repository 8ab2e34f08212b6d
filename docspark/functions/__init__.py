"""Column expressions: text in, Column out; no Python runs per row."""
