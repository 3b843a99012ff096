"""Column functions: levels and scalars."""
