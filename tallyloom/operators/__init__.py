"""Relational operators on the canonical tables."""
