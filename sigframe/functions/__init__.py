"""Column functions: complex structs, counter-based noise, filter design."""
