"""Relational operators over graphs."""
