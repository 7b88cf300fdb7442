"""Registered jobs over the given tables."""
