"""Column helpers built from Spark functions."""
