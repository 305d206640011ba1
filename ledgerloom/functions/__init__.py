"""Column expressions: scalar parsing, rendering and matching."""
