"""Column functions. Everything here stays in Spark's own expressions."""
