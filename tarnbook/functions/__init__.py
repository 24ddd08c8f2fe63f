"""Column functions; each takes and returns columns and stays inside generated code."""
