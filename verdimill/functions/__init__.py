"""Column builders: distributions, text, JSON and keys."""
