"""Column expressions and block arithmetic."""
