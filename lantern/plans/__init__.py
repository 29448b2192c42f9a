"""Registered queries: each runs one of the library's jobs over the given tables."""
