"""The row-wise stages on streaming tables."""
