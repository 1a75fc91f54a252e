"""Composed queries, their registration and their SQL equivalents."""
