"""Column expressions and small kernels."""
