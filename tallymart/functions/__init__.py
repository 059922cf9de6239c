"""Column functions: plain expressions, no Python in the row path."""
