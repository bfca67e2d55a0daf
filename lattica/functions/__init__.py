"""Scalar functions, as column expressions where Spark has them and Python where not."""
