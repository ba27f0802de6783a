"""Column builders: pure expressions, no Python in the data path."""
