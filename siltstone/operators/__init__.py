"""Operators of the code-analytics engine."""
