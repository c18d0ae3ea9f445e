"""Operators on observations, evidence and graphs."""
