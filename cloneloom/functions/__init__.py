"""Scalar functions as column expressions, and graph kernels."""
