"""Scalar expressions and the function library."""
