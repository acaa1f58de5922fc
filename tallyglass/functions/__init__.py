"""Column builders: pure expressions, no UDFs."""
