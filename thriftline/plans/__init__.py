"""Whole jobs: the project lifecycle and the registered queries."""
