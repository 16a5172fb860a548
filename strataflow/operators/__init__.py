"""Operators that Spark's SQL doesn't have as one word."""
