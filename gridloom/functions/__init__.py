"""Column expressions with NumPy's meaning."""
