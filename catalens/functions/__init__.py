"""Column-to-column functions: native expressions only, no UDFs."""
