"""Relational operators over long observation tables."""
