"""Column functions: sketches, versions, labels, error messages."""
