"""DataFrame operators of the code-impact pipeline."""
