"""Column expressions: no shuffles, no Python UDFs."""
