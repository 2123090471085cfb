"""Scalar functions: predicates of expressions, and coercions."""
