"""Scalar functions: regular expressions, JSON slices, addresses, templates and time layouts."""
