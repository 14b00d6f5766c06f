"""Column-expression helpers and distributed building blocks."""
