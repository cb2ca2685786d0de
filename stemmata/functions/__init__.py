"""Scalar functions, as column expressions; Arrow functions only where Spark has no counterpart."""
