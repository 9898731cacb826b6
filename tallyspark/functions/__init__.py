"""Scalar functions as Column expressions, and the few vectorised Python ones that no expression can give."""
