"""Continuous collection of spans into a stored graph."""
