"""Column functions on field elements."""
