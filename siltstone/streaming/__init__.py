"""Streaming of the code-analytics engine."""
