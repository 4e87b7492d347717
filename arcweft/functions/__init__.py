"""Scalar functions: casings of names, text helpers."""
