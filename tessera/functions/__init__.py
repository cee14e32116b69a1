"""Column functions: bit arithmetic, pixels, and byte serialization."""
