"""Sources of the code-analytics engine."""
