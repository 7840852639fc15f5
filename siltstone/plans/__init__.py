"""Plans of the code-analytics engine."""
