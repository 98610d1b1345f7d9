"""Column expressions: all built from Spark functions, no UDFs."""
