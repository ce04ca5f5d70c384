"""Operators on DataFrames bound to roles; every one works on all entities at once."""
