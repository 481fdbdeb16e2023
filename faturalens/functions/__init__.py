"""Column functions: fixed values, text shaping, strict JSON, number parsing."""
