"""Functions for columns."""
