"""Column expressions: periods, numbers and text."""
