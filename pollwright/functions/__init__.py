"""Column expressions and the few helpers that keep skewed data spread out."""
