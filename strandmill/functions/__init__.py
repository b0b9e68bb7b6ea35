"""Column functions on sequences."""
