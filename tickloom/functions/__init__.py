"""Column expressions shared by the operators. No UDFs."""
