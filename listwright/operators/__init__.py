"""Relational operators over listing tables."""
