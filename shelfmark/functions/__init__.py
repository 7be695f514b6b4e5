"""Column expressions and small per-value helpers."""
