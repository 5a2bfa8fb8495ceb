"""Column functions: one column in, one column out."""
