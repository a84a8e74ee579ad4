"""Relational operators of the core."""
