"""Functions of the code-analytics engine."""
