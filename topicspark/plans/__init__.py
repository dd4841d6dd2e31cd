"""Composite queries and the registry."""
